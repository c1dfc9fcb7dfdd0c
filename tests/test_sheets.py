"""Style sheets: the parser, selectors, and the cascade against a walk over each page's elements."""

import random

import pytest
from pyspark.sql import functions as F

from lumenweft.operators import collect, sheets
from lumenweft.operators import extract as X

RULES = [
    ("a{background:url(x)}b{color:red}", [("a", "background:url(x)"), ("b", "color:red")]),
    ("/* a{} */ @import 'x;{'; @media print{a{b:c}} @media only screen, print{a{b:c}}", [("a", "b:c")]),
    ("@font-face{src:url(f)} @supports (x:y){p{q:r}} @keyframes k{from{a:b}}", [("p", "q:r")]),
    ('p{content:"}";a:b}q{', [("p", 'content:"}";a:b'), ("q", "")]),
    ("a{x:y;b{z:w}}}c{d:e", [("a", "x:y;"), ("c", "d:e")]),
    ("", []),
]


@pytest.mark.parametrize("css, want", RULES)
def test_rules(css, want):
    assert list(sheets.rules(css)) == want


def test_declarations():
    assert sheets.declared("color:red;BACKGROUND : url( 'a;b.png' ) ! IMPORTANT;background-image:none;background-color:url(x)") == [(True, ["a;b.png"]), (False, [])]
    assert sheets.declared("background:url(data:image/png;base64,AA==)") == [(False, ["data:image/png;base64,AA=="])]
    assert sheets.declared("") == [] and sheets.declared("background:") == []


def test_selectors():
    assert sheets.selector("*")[0] == (0, 0, 0)
    weight, parts = sheets.selector("DIV#a.b.c > .md\\:x + [k|='v'] ~ p q")
    assert weight == (1, 4, 3) and [p["comb"] for p in parts] == ["", ">", "+", "~", " "] and [p["key"] for p in parts] == ["#a", ".md:x", "*", "p", "q"]
    assert all(sheets.selector(s) is None for s in ("", "a:hover", "a::before", "> a", "a >", "#a#b", "a >> b", "&"))
    assert sheets.listed("a[x=','],b:is(c,d),e") == ["a[x=',']", "b:is(c,d)", "e"]


def _random_page(r: random.Random) -> str:
    def one(depth: int) -> str:
        tag, cls = r.choice("bius"), " ".join(r.sample("xyz", r.randint(0, 2)))
        own = r.choice(["", "", f' style="background:url(o{r.randint(0, 9)})"'])
        inner = "".join(one(depth + 1) for _ in range(r.randint(0, 3))) if depth < 4 else ""
        return f'<{tag} class="{cls}" id="{r.choice("mn")}"{own}>{inner}</{tag}>'

    simple = lambda: r.choice(["b", "i", "u", "s", ".x", ".y", ".z", "#m", "*", "b.x", "[class~=y]"])
    rule = lambda k: f"{simple()}{''.join(r.choice([' ', '>', '+', '~']) + simple() for _ in range(r.randint(0, 3)))}{{background:{r.choice([f'url(r{k})', 'none'])}{r.choice(['', '', ' !important'])}}}"
    return f"<style>{''.join(rule(k) for k in range(8))}</style>" + "".join(one(0) for _ in range(3)) + f"<style>{rule(8)}</style>"


def _walked(html: str) -> dict[int, list[str]]:
    """The cascade by trying every rule on every element, from the right to the left."""
    rows = {e[2]: e for e in X.tokenise(html)}
    siblings = lambda at: [k for k in sorted(rows) if rows[k][3] == rows[at][3] and k < at]

    def fits(at, p):
        tag, attrs = rows[at][5:7]
        words = attrs.get("class", "").split()
        return (not p["tag"] or p["tag"] == tag) and (not p["id"] or p["id"] == attrs.get("id")) and all(c in words for c in p["classes"]) and all(t["value"] in words for t in p["tests"])

    def ends(at, parts):
        if not fits(at, parts[-1]):
            return False
        if len(parts) == 1:
            return True
        comb, up = parts[-1]["comb"], rows[at][3]
        if comb in ">+":
            near = [up] if comb == ">" else siblings(at)[-1:]
            return any(k >= 0 and ends(k, parts[:-1]) for k in near)
        if comb == "~":
            return any(ends(k, parts[:-1]) for k in siblings(at))
        while up >= 0:
            if ends(up, parts[:-1]):
                return True
            up = rows[up][3]
        return False

    best: dict[int, tuple] = {}
    for at, e in rows.items():
        if e[5] == "style":
            for n, (heads, body) in enumerate(sheets.rules(e[7])):
                for important, urls in sheets.declared(body):
                    for weight, parts in filter(None, map(sheets.selector, sheets.listed(heads))):
                        for k in rows:
                            if ends(k, parts):
                                best[k] = max(best.get(k, ()), ((important, 0, *weight, at, n), urls))
        for n, (important, urls) in enumerate(sheets.declared(e[6].get("style", ""))):
            best[at] = max(best.get(at, ()), ((important, 1, 0, 0, 0, 0, n), urls))
    return {k: v[1] for k, v in best.items()}


def test_cascade_against_a_walk(spark):
    r = random.Random(5)
    pages = [(k, "https://a.example/", _random_page(r)) for k in range(30)] + [(30, None, None), (31, None, ""), (32, None, "<style></style><p style='background:'>")]
    elems = X.elements(spark.createDataFrame(pages, "page_id long, url string, html string")).withColumn("first", F.lit("clash"))
    got: dict = {}
    for row in sheets.cascaded(elems).collect():
        assert row["elem_ordinal"] not in got.setdefault(row["page_key"], {})
        got[row["page_key"]][row["elem_ordinal"]] = row["styled"]
    for k, _, html in pages:
        assert got.get(k, {}) == _walked(html or ""), html
    assert sum(len(v) for v in got.values()) > 300
    assert sheets.cascaded(elems.where("false")).count() == 0


def test_the_scan_takes_backgrounds_by_sheets(spark):
    html = '<style>.h{background:url(/sheet.png)} #k{background:none}</style><div class="h"></div><div style="background:url(/own.png)"></div><div id="k" style="background:url(/own2.png)"></div><img src="/i.png">'
    pages = spark.createDataFrame([(1, "https://a.example/", html), (2, "https://b.example/", '<p style="background:url(x.png)">')], "page_id long, url string, html string")
    got = [(r["page_id"], r["src"]) for r in collect.media(pages).orderBy("page_id", "seq").collect()]
    assert got == [(1, "https://a.example/i.png"), (1, "https://a.example/sheet.png"), (1, "https://a.example/own.png"), (1, "https://a.example/own2.png"), (2, "https://b.example/x.png")]
