"""Stored HTML to elements, and elements to media URLs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from lumenweft.functions import url as U
from lumenweft.functions.text import F
from lumenweft.functions.url import absolute
from lumenweft.operators import tree as T
from lumenweft.operators.css import applies, backgrounds, element_keys, named_keys

ELEMENTS = "page_key bigint, page_id bigint, url string, root_no int, doc_no int, elem_ordinal int, parent int, subtree_end int, tag string, attrs map<string,string>, text string, listed array<array<string>>, found array<string>, keys array<string>"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# Attributes in their order of priority.
LAZY_SRC = (
    "data-orig-file", "data-large-file", "data-src", "data-original", "data-original-src", "data-actualsrc", "data-lazy-src", "data-lazy", "data-lazyload", "data-hi-res-src", "data-src-large",
    "data-full-src", "data-image", "data-echo", "data-flickity-lazyload", "data-url",
)
SRCSETS = ("srcset", "data-srcset", "data-lazy-srcset")
LAZY_BACKGROUNDS = ("data-bg", "data-background", "data-background-image")
#: Elements of a page that a task hands over at once.
ELEMENT_ROWS = 10_000


@dataclass
class Root:
    """A document, or an open shadow root, and what is nested in it."""

    doc: Root | None = None  # its document; None: it is one
    nodes: list[list] = field(default_factory=list)  # parent, tag, attrs, pieces of its own text, last descendant
    shadows: list[Root] = field(default_factory=list)


class _Parser(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style", "noscript")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.document = Root()
        self.open: list[tuple[Root | None, int, str, Root | None]] = []  # root, place there, tag, root of its children
        self.places: dict[str, list[int]] = {}  # of each tag in open

    def _add(self, tag: str, attrs: list) -> tuple[Root | None, int, dict]:
        root = self.open[-1][3] if self.open else self.document
        values = {k: v or "" for k, v in reversed(attrs)}
        if root is None:
            return None, -1, values
        above = next((i for r, i, _, _ in reversed(self.open) if r is root), -1)
        root.nodes.append([above, tag, values, [], len(root.nodes)])
        return root, len(root.nodes) - 1, values

    def handle_starttag(self, tag, attrs):
        root, at, values = self._add(tag, attrs)
        if tag in VOID:
            return
        inside = root
        if tag == "template":  # its content is no part of the page, or that of a shadow root
            inside = None
            if root is not None and values.get("shadowrootmode", "").lower() == "open":
                inside = Root(root.doc or root)
                root.shadows.append(inside)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((root, at, tag, inside))

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def _close(self) -> None:
        root, at, tag, _ = self.open.pop()
        self.places[tag].pop()
        if root is not None:
            root.nodes[at][4] = len(root.nodes) - 1

    def handle_endtag(self, tag):
        if self.places.get(tag):
            last = self.places[tag][-1]
            while len(self.open) > last:
                self._close()

    def handle_data(self, data):
        if self.open and self.open[-1][0] is not None and self.open[-1][3] is self.open[-1][0]:
            root, at, _, _ = self.open[-1]
            root.nodes[at][3].append(data)

    def close(self):
        super().close()
        while self.open:
            self._close()


def document(html: str) -> Root:
    p = _Parser()
    p.feed(html)
    p.close()
    return p.document


def tokenise(html: str) -> list[tuple]:
    """(root, document, ordinal, parent, last descendant, tag, attrs, text) of each element; the text is its own, without its children's.

    Roots are numbered as they are found: the page, then what is nested in each root, its open shadow roots (declared by
    templates) before the documents of its srcdoc frames. Ordinals go on from root to root, so an element's descendants
    in its own root are those behind it up to its last one, and no element of another root is among them. -1: no parent.
    """
    rows, queue, numbers = [], [document(html)], {}
    for number, root in enumerate(queue):  # the queue grows
        numbers[id(root)] = number
        at, doc = len(rows), number if root.doc is None else numbers[id(root.doc)]
        for i, (up, tag, attrs, text, last) in enumerate(root.nodes):
            rows.append((number, doc, at + i, up + at if up >= 0 else -1, at + last, tag, attrs, "".join(text)))
        queue += root.shadows
        queue += [document(n[2]["srcdoc"]) for n in root.nodes if n[1] == "iframe" and n[2].get("srcdoc")]
    return rows


def _listed(tag: str, attrs: dict[str, str]) -> list[list[str]]:
    """The candidates of the srcsets of an element."""
    names = SRCSETS if tag in ("img", "source") else ("imagesrcset",) if tag == "link" else ()
    return [split_srcset(attrs.get(a)) for a in names]


STYLE = re.compile(r"background(?:-image)?\s*:\s*(.*?)(?:;\s*[a-z-]+\s*:|$)", re.I | re.S)


def _found(tag: str, attrs: dict[str, str], text: str) -> list[str]:
    """Addresses of the backgrounds of an element's style, or of the images in a noscript element."""
    if tag == "noscript":
        return noscript_urls(text)
    m = STYLE.search(attrs["style"]) if "background" in attrs.get("style", "").lower() else None
    return backgrounds(m[1]) if m else []


def _sheet_keys(rows: list[tuple]) -> dict[int, set[str]]:
    """For each root with sheets that give backgrounds the keys that their selectors ask for."""
    out: dict[int, set[str]] = {}
    for e in rows:
        if e[5] == "style" and "background" in e[7].lower() and applies(e[6].get("media")):
            out.setdefault(e[0], set()).update(named_keys(e[7]))
    return out


PAGE = "#page"


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    whole, text = {"page_key": pa.int64(), "page_id": pa.int64()}, pa.string()
    kinds = {"url": text, "tag": text, "text": text, "attrs": pa.map_(text, text), "listed": pa.list_(pa.list_(text)), "found": pa.list_(text), "keys": pa.list_(text)} | whole
    names = [c.split()[0] for c in ELEMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int32())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def elements(pages: DataFrame, page_rows: Column | None = None) -> DataFrame:
    """One row for each element of each page, in one pass. Store it before several scans use it. Null html: none.

    page_key tells the rows of pages apart: the column of that name where pages has one, else page_id. With page_rows
    every page has one more row, of tag PAGE and ordinal -1, whose text is the page's html where page_rows holds. keys are
    those of an element that a sheet of its root asks for, so few elements have any.
    """
    key = F.col("page_key" if "page_key" in pages.columns else "page_id").cast("bigint").alias("page_key")
    whole = F.lit(None).cast("boolean") if page_rows is None else F.coalesce(page_rows, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for k, p, u, h, w in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = tokenise(h or "")
                asked = _sheet_keys(rows)
                if w is not None:
                    rows.append((0, 0, -1, -1, -1, PAGE, {}, (h or "") if w else ""))
                for e in rows:
                    held.append((k, p, u, *e[:6], list(e[6].items()), e[7], _listed(e[5], e[6]), _found(*e[5:8]), [n for n in element_keys(e[5], e[6]) if n in asked[e[0]]] if e[0] in asked and e[5] != PAGE else []))
                    if len(held) == ELEMENT_ROWS:
                        yield _arrow(held)
                        held = []
        if held:
            yield _arrow(held)

    return pages.select(key, F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), whole.alias("whole")).mapInArrow(run, ELEMENTS)


# ---- srcset and backgrounds -------------------------------------------------------------------------------------


def split_srcset(text: str | None) -> list[str]:
    """Candidates of a srcset. A comma parts candidates only at the end of a URL or after a descriptor."""
    out, at, text = [], 0, text or ""
    while (m := re.compile(r"[ \t\n\r\f,]*([^ \t\n\r\f]+)").match(text, at)) is not None:
        url, at = m[1], m.end()
        if url.endswith(","):
            url = url.rstrip(",")
            if url:
                out.append(url)
            continue
        end = text.find(",", at)
        end = len(text) if end < 0 else end
        descriptor = text[at:end].strip()
        out.append(f"{url} {descriptor}" if descriptor else url)
        at = end + 1
    return out


NOSCRIPT_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&amp;", "&"))


def _best_listed(candidates: list[str]) -> str | None:
    """As best_srcset()."""

    def rate(c: str, unit: str) -> float:
        m = re.search(rf"([\d.]+){unit}", c.partition(" ")[2])
        try:
            return float(m[1]) if m else 0.0
        except ValueError:
            return 0.0

    best = max(candidates, key=lambda c: (rate(c, "w"), rate(c, "x")), default=None)  # the first of equal ones
    return best and best.split(" ")[0]


def noscript_urls(text: str) -> list[str]:
    """src and the best of srcset of the images in a noscript element's text, which is decoded once if it is escaped."""
    if "<img" not in text and "&lt;" in text:
        for a, b in NOSCRIPT_ENTITIES:
            text = text.replace(a, b)
    out = []
    for tag in re.findall(r"(?is)<img\b[^>]*>", text):
        value = lambda a: next(iter(re.findall(rf"""(?is)\s{a}\s*=\s*["']([^"']*)["']""", tag)), "")  # noqa: E731, B023
        out += [x for x in (value("src"), _best_listed(split_srcset(value("srcset")))) if x]
    return out


def candidate_url(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\S+)", 1)


def best_srcset(candidates: Column) -> Column:
    """The URL of the widest, then the densest candidate, the first of equal ones. candidates: as split."""
    number = lambda c, unit: F.coalesce(F.regexp_extract(F.regexp_extract(c, r"^\S+\s+(.*)$", 1), rf"([\d.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    rated = F.transform(candidates, lambda c, i: F.struct(number(c, "w").alias("w"), number(c, "x").alias("x"), (-i).alias("place"), candidate_url(c).alias("url")))
    return F.array_max(rated)["url"]


def attr(name: str) -> Column:
    value = F.try_element_at(F.col("attrs"), F.lit(name))
    return F.when(value != "", value)


def image_found() -> Column:
    """The addresses that an img or source element names: lazy attributes, src, srcsets with the best first, lazy backgrounds; each once."""
    lists = [F.coalesce(F.get(F.col("listed"), F.lit(i)), F.array().cast("array<string>")) for i in range(len(SRCSETS))]
    sets = [x for c in lists for x in (F.array(best_srcset(c)), F.transform(c, candidate_url))]
    plain = F.transform(F.array(*map(attr, LAZY_BACKGROUNDS)), lambda x: F.when(x.rlike(r"url\("), F.regexp_extract(x, r"""url\(\s*['"]?(.*?)['"]?\s*\)""", 1)).otherwise(x))
    return F.array_distinct(F.filter(F.array_compact(F.concat(F.array(*map(attr, LAZY_SRC), attr("src")), *sets, plain)), lambda x: x != ""))


def is_image() -> Column:
    """img, and a source of a picture: sources of video and audio have a src, those of pictures a srcset."""
    return (F.col("tag") == "img") | ((F.col("tag") == "source") & F.coalesce(*map(attr, SRCSETS)).isNotNull())


def size_of(name: str) -> Column:
    """The whole number that an attribute begins with, else 0."""
    return F.coalesce(F.regexp_extract(attr(name), r"^\s*(\d+)", 1).try_cast("int"), F.lit(0))


def image_urls(elems: DataFrame) -> DataFrame:
    """(page_id, elem_ordinal, sub_ordinal, url, src) of img and source elements, as image_found()."""
    out = elems.where(is_image()).select("page_id", "elem_ordinal", "url", "tag", F.coalesce(attr("alt"), F.lit("")).alias("alt"), size_of("width").alias("width"), size_of("height").alias("height"), attr("src").alias("own"), F.posexplode(image_found()).alias("sub_ordinal", "raw"))
    return out.select("page_id", "url", "elem_ordinal", "sub_ordinal", "tag", "alt", "width", "height", "own", "raw", F.when(F.col("raw").startswith("data:"), F.col("raw")).otherwise(absolute(F.col("raw"), F.col("url"))).alias("src"))


def css_backgrounds(elems: DataFrame) -> DataFrame:
    rows = elems.where(F.col("tag") != "noscript").select("page_id", "elem_ordinal", "url", F.posexplode("found").alias("sub_ordinal", "raw"))
    return rows.select("page_id", "elem_ordinal", "sub_ordinal", absolute(F.col("raw"), F.col("url")).alias("src"))


def poster_of() -> Column:
    return F.when(attr("poster").rlike(r"^(?i:https?:|data:image/)"), attr("poster"))


def av_sources(elems: DataFrame) -> DataFrame:
    """Sources of video and audio elements: src, data-src, then the child sources with their MIME types; type, poster and alt."""
    hosts = elems.where(F.col("tag").isin("video", "audio"))
    alt = F.coalesce(attr("aria-label"), attr("title"), F.lit("")).alias("alt")
    head = (F.col("tag").alias("kind"), poster_of().alias("poster"), alt)
    own = hosts.select("page_id", "url", F.col("elem_ordinal").alias("host"), *head, F.posexplode(F.array_compact(F.array(attr("src"), attr("data-src")))).alias("sub_ordinal", "raw")).withColumn("mime", F.lit(None).cast("string"))
    inner = T.places(elems.where((F.col("tag") == "source") & attr("src").isNotNull()), attr("src").alias("raw"), attr("type").alias("mime"))
    below = T.enclosed(inner, T.intervals(hosts, "page_id", "url", *head)).select("page_id", "url", F.col("first").alias("host"), "kind", "poster", "alt", (F.col("at") + 10).alias("sub_ordinal"), "raw", "mime")
    src = absolute(F.col("raw"), F.col("url"))
    return own.unionByName(below).select("page_id", F.col("host").alias("elem_ordinal"), "sub_ordinal", "kind", src.alias("src"), U.av_type(src, F.col("mime")).alias("type"), "poster", "alt")


def hero_images(elems: DataFrame) -> DataFrame:
    """og:image and twitter:image of a page's meta elements."""
    name = F.lower(F.coalesce(attr("property"), attr("name"), F.lit("")))
    kinds = ("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src")
    rows = elems.where((F.col("tag") == "meta") & name.isin(*kinds) & attr("content").isNotNull())
    return rows.select("page_id", "elem_ordinal", name.alias("name"), absolute(attr("content"), F.col("url")).alias("src"))


def hero_videos(elems: DataFrame) -> DataFrame:
    """og:video of a page, typed by og:video:type or the address, with og:image for a poster."""
    name = F.lower(F.coalesce(attr("property"), attr("name"), F.lit("")))
    meta = elems.where((F.col("tag") == "meta") & attr("content").isNotNull()).select("page_id", "url", "elem_ordinal", name.alias("name"), attr("content").alias("content"))
    first = lambda n: F.min_by("content", F.when(F.col("name") == n, F.col("elem_ordinal")))
    per = meta.groupBy("page_id", "url").agg(F.coalesce(first("og:video:secure_url"), first("og:video:url"), first("og:video")).alias("raw"), first("og:video:type").alias("mime"), first("og:image").alias("poster"))
    src = absolute(F.col("raw"), F.col("url"))
    return per.where("raw is not null").select("page_id", src.alias("src"), U.av_type(src, F.col("mime")).alias("type"), "poster")


def is_preload() -> Column:
    return (F.col("tag") == "link") & F.array_contains(F.split(F.lower(attr("rel")), r"\s+"), "preload") & (F.lower(attr("as")) == "image")


def preload_found() -> Column:
    listed = F.coalesce(F.get(F.col("listed"), F.lit(0)), F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.array(attr("href"), best_srcset(listed))))


def preloads(elems: DataFrame) -> DataFrame:
    """Images that a page preloads: href and the best of imagesrcset."""
    rows = elems.where(is_preload()).select("page_id", "elem_ordinal", "url", F.posexplode(preload_found()).alias("sub_ordinal", "raw"))
    return rows.select("page_id", "elem_ordinal", "sub_ordinal", absolute(F.col("raw"), F.col("url")).alias("src"))


def noscript_images(pages: DataFrame) -> DataFrame:
    """Images inside of noscript elements, decoded once if their markup is escaped."""
    rows = elements(pages).where("tag = 'noscript'").select("page_id", "elem_ordinal", "url", F.posexplode("found").alias("sub_ordinal", "raw"))
    return rows.select("page_id", "elem_ordinal", "sub_ordinal", absolute(F.col("raw"), F.col("url")).alias("src"))


def main_image(pages: DataFrame) -> DataFrame:
    """The main image of a stored gallery page: og:image:secure_url, og:image, twitter:image, twitter:image:src, link image_src, else the image with the largest declared width."""
    elems = elements(pages)
    name = F.lower(F.coalesce(attr("property"), attr("name"), F.lit("")))
    place = F.array_position(F.array(*map(F.lit, ("og:image:secure_url", "og:image", "twitter:image", "twitter:image:src"))), name)
    meta = elems.where((F.col("tag") == "meta") & (place > 0) & attr("content").isNotNull()).select("page_id", "url", F.struct(place.cast("int").alias("p"), F.lit(0).alias("w"), "elem_ordinal").alias("rank"), attr("content").alias("raw"))
    link = elems.where((F.col("tag") == "link") & (F.lower(attr("rel")) == "image_src") & attr("href").isNotNull()).select("page_id", "url", F.struct(F.lit(5).alias("p"), F.lit(0).alias("w"), "elem_ordinal").alias("rank"), attr("href").alias("raw"))
    width = F.coalesce(F.regexp_extract(attr("width"), r"^(\d+)", 1).try_cast("int"), F.lit(0))
    img = elems.where((F.col("tag") == "img") & attr("src").isNotNull()).select("page_id", "url", F.struct(F.lit(6).alias("p"), (-width).alias("w"), "elem_ordinal").alias("rank"), attr("src").alias("raw"))
    best = meta.unionByName(link).unionByName(img).groupBy("page_id").agg(F.min_by(F.struct("raw", "url"), "rank").alias("b"))
    return best.select("page_id", absolute(F.col("b.raw"), F.col("b.url")).alias("src"))


#: Fixed value: first path segments of routes that are no media page.
NON_CONTENT_PATH = (
    r"(?i)^/(?:authors?|tags?|categor(?:y|ies)|topics?|users?|profiles?|members?|about|contact|search|explore|login|sign[-_]?in|sign[-_]?up|register|account|settings|feeds?|rss|pages?|cart|checkout|privacy|terms|help|faq|"
    r"share|subscribe|newsletter)(?:/|$)"
)
GALLERY_PAGE_CAP = 60
GALLERY_MIN_THUMB = 64


def gallery_links(anchors: DataFrame, cap: int = GALLERY_PAGE_CAP) -> DataFrame:
    """anchors (page_id, url, ord, href, thumb_width) that may lead to a gallery page: same site, no listing page, a thumbnail of 64 pixels or unknown size; so many a page."""
    from pyspark.sql import Window as W

    target = absolute(F.col("href"), F.col("url"))
    rows = anchors.withColumn("target", target).where((U.origin(F.col("target")) == U.origin(F.col("url"))) & ~U.path(F.col("target")).rlike(NON_CONTENT_PATH) & F.coalesce((F.col("thumb_width") == 0) | (F.col("thumb_width") >= GALLERY_MIN_THUMB), F.lit(True)))
    w = W.partitionBy("page_id").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
