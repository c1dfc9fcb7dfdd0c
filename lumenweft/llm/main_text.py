"""Main text of a page by line-block distribution.

Markup is stripped in one pass that leaves lines: runs of text between block-level tags, each with the length of its
text, the part of it inside links, and whether it lies in a boilerplate container (menu, header, footer, sidebar,
notice, advert, form, comments). The text lengths of the lines, less link text and boilerplate, are summed over a
sliding window of lines. A surge point is where the sum rises over a threshold and stays up in the next lines; the next
dive point is where it falls to nothing. Lines from a surge to its dive are kept. Article and main elements are a weight
on their lines' text, so less of it is a surge; boilerplate inside of them is left out of the windows, so it makes no
dive. A name alone makes an element of an article boilerplate only if all of its words are such, and if the elements so
named hold less text than the rest of the article. Lines outside count for nothing only where the element holds at least half of the page's text. Outside of such
elements a line of links alone is never kept.
"""

from __future__ import annotations

import html as html_module
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm._common import small_batches, table

#: Lines in a window, and the weighted text that a window must hold at a surge.
WINDOW = 3
SURGE = 60
#: What a character counts elsewhere, in a main element and in an article.
WEIGHT = (1, 2, 4)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Without their end tags these take all that follows; the others of RAW are then nothing but a tag.
ENDLESS = frozenset("script style".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
#: Elements whose whole content is not text of the article.
SKIPPED = frozenset("nav footer aside noscript template form button select option datalist head dialog menu svg math canvas object audio video map fieldset label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of the first kind ends where one of the second begins.
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
WORD = re.compile(r"[a-z]+")
#: Words of class, id and role that name boilerplate.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promotion promoted outbrain taboola
    nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs
    footer foot masthead topbar bottombar colophon
    sidebar aside rail widget widgets related recommended recommendations trending popular
    comment comments commentlist disqus replies reply respond discussion reactions feedback
    notice notices notification notifications announcement cookie cookies consent gdpr alert popup modal overlay subscribe subscription newsletter signup login paywall disclaimer toast
    share sharing social socials follow
    form search searchbox
    banner complementary contentinfo navigation search dialog alert alertdialog""".split()
)
#: A page's own header holds menus and notices, the header inside of an article its title.
HEADER_NAMES = frozenset("header head".split())
#: Even an article element is none of the article's text if it is a reader's comment.
COMMENT_NAMES = frozenset("comment comments reply replies".split())
#: Names that say that something is there or is not, not what the element is.
ABSENT = re.compile(r"\b(?:has|with|no|without)[-_][a-z]+")
#: Words beside those of NAMES in names of boilerplate. Inside an article a name with any other word says nothing: share-prices, cookie-recipe.
LAYOUT_NAMES = frozenset(
    """area bar block body bottom box btn button buttons card cards center column container content footer grid group header heading holder icon icons img inline inner item items label large left line link links list
    main media mid module more news outer panel post posts article articles row section site slot small stories story text title tool tools top unit wrap wrapper right js js el id primary secondary""".split()
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    linked: int
    boiler: int  # 2: in boilerplate; 1: in an element of an article that is only named like it; 0: elsewhere
    article: int  # 2: in an article element; 1: in a main one; 0: elsewhere


def _named(attributes: str) -> tuple[list[set[str]], str, bool]:
    """The words of each name of class, id and role; the role; whether the element is hidden."""
    names, role, hidden = [], "", False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            plain = ABSENT.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
            names += [set(WORD.findall(name)) for name in plain.split()]
            role = plain.strip() if name == "role" else role
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            hidden = True
    return names, role, hidden


def _inside(tag: str, attributes: str, boiler: int, article: int) -> tuple[int, int]:
    """How the text inside of an element is boilerplate, and its article level, given those around it."""
    names, role, hidden = _named(attributes) if attributes.strip() else ([], "", False)
    words = set().union(*names)
    if tag in ("html", "body"):
        return boiler, article
    if tag in SKIPPED or hidden or tag == "header" and not article:
        return 2, article
    if tag == "article" or tag == "main" or role == "main":
        own = words & COMMENT_NAMES
        return 2 if own else boiler, article if boiler or own else max(article, 2 if tag == "article" else 1)
    if article:
        return max(boiler, int(any(n & NAMES and n <= NAMES | LAYOUT_NAMES for n in names))), article
    return 2 if words & NAMES or words & HEADER_NAMES else boiler, article


def lines(page: str) -> list[Line]:
    """The page's lines in order. Damaged markup ends what it can: an open tag or comment at the end is dropped."""
    out: list[Line] = []
    # open elements: (tag, boilerplate inside, article level inside, innermost block up to it, number of blocks up to it)
    stack: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]
    places: dict[str, list[int]] = defaultdict(list)  # of each tag in the stack
    unended: set[str] = set()  # raw elements that have no end tag behind this place
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html_module.unescape("".join(parts))).strip()
            if text:
                out.append(Line(text, linked, stack[-1][1], stack[-1][2]))
            parts.clear()
        linked = 0

    def shut(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop()[0]].pop()

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = 0
            if tag not in INLINE:
                flush()
            if places[tag]:
                depth = places[tag][-1]
                if tag in INLINE and stack[-1][4] > stack[depth - 1][4]:
                    continue  # an inline end tag does not end blocks
                shut(depth)
            continue
        attributes = m[3] or ""
        if tag in RAW:
            flush()
            end = None if tag in unended else RAW_END[tag].search(page, at)
            if end is None:
                unended.add(tag)
            at = end.end() if end else size if tag in ENDLESS else at
            continue
        if tag not in INLINE:
            flush()
            while len(stack) > 1 and tag in CLOSES.get(stack[-1][0], ()):
                shut(len(stack) - 1)
            inner = stack[-1][3]
            if tag in CLOSES["p"] and stack[inner][0] == "p":  # a block inside the p's inline elements ends the p, too
                shut(inner)
        if tag == "a":
            links = 1  # links do not nest
        if tag in VOID or attributes.rstrip().endswith("/") and tag in INLINE:
            continue
        block = tag not in INLINE
        places[tag].append(len(stack))
        stack.append((tag, *_inside(tag, attributes, *stack[-1][1:3]), len(stack) if block else stack[-1][3], stack[-1][4] + block))
    flush()
    return out


def regions(sums: list[int], own: list[int], surge: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches from a surge point to the next dive point.

    sums[i]: text in the window that begins at line i. A surge: sums[i] is at least surge and line i has text.
    A dive: a whole window without text.
    """
    out, i, n = [], 0, len(own)
    while i < n:
        if own[i] and sums[i] >= surge:
            end = i
            while end < n and sums[end]:
                end += 1
            out.append((i, end))
            i = end
        i += 1
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text; empty if it has none. Null: empty."""
    found = lines(page or "")
    weight = lambda boiler: sum(len(x.text) - min(x.linked, len(x.text)) for x in found if x.article and x.boiler == boiler)
    most = 1 if weight(1) > weight(0) else 0  # elements that hold most of an article's text are that, whatever their names
    found = [Line(x.text, x.linked, 0, x.article) if x.article and x.boiler <= most else x for x in found if not (x.article and x.boiler > most)]
    plain = [0 if x.boiler or x.linked and x.linked >= 0.9 * len(x.text) and not x.article else len(x.text) - (0 if x.article else min(x.linked, len(x.text))) for x in found]
    # a marked element stands for the page only if it holds at least half of its text
    held = [sum(n for x, n in zip(found, plain) if x.article >= k) for k in (0, 1, 2)]
    level = next(k for k in (2, 1, 0) if 2 * held[k] >= held[0])
    own = [n * WEIGHT[x.article] if x.article >= level else 0 for x, n in zip(found, plain)]
    sums = [sum(own[i : i + window]) for i in range(len(own))]
    surge = min(surge, max(sums, default=0) // 2 + 1)  # a page of little text has its surge, too
    kept = [found[i].text for a, b in regions(sums, own, surge) for i in range(a, b) if own[i]]
    return " ".join(kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text, n_chars of every page, from the whole html.

    Null or empty html: empty text. Null page_id or url is carried. Repeated rows each give a row. Empty table: no rows.
    """
    small_batches(pages.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, window, surge) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op1_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_line_blocks": op1_line_blocks}
ORACLES: dict[str, str] = {}
