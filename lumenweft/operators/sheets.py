"""Style sheets of stored pages: which background each element has by the cascade.

Sheets are read into rules as data: a rank (important, inline, specificity, place) and the compounds of a selector.
All compounds of all selectors meet elements in one equi-join on page, root and one key of the compound (its id, else its
first class, else its tag), so no rule is tried on elements that it cannot name. The map that finds the elements notes which
of their keys a sheet of their root asks for, so the others never reach the shuffle. Combinators are then followed from the left:
each step keeps the elements that end a selector's first compounds, by equi-joins for >, + and ~, and by intervals for
descendants, of which the outermost suffice. The greatest rank of an element is one aggregate, combined before the shuffle.

Rules hold in the root of their sheet alone. Read are style elements and style attributes; sheets of other addresses are not
stored. What of their text counts is said in operators.css.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.functions.url import absolute
from lumenweft.operators import tree as T
from lumenweft.operators.css import applies, declared, listed, rules, selector
from lumenweft.sources.shared import stored

COMPOUND = pa.struct([("comb", pa.string()), ("key", pa.string()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("tests", pa.list_(pa.struct([("name", pa.string()), ("how", pa.string()), ("value", pa.string())])))])
DECLARED = (
    "page_key bigint, root_no int, sheet int, sel int, rank array<int>, found array<string>, "
    "parts array<struct<comb:string,key:string,tag:string,id:string,classes:array<string>,tests:array<struct<name:string,how:string,value:string>>>>"
)
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(COMPOUND))
RULE = ["page_key", "root_no", "sheet", "sel"]
#: Declarations that a task hands over at once.
RULE_ROWS = 5_000

def _of_sheet(page: int, root: int, at: int, css: str) -> Iterator[tuple]:
    place = sel = 0
    for heads, body in rules(css):
        found = declared(body)
        if not found:
            continue
        known = [s for s in map(selector, listed(heads)) if s is not None]
        for important, urls in found:
            place += 1
            for weight, parts in known:
                yield page, root, at, sel, [int(important), 0, *weight, at, place], urls, parts
                sel += 1


def _of_attribute(page: int, root: int, at: int, style: str) -> Iterator[tuple]:
    for place, (important, urls) in enumerate(declared(style)):
        yield page, root, at, place, [int(important), 1, 0, 0, 0, 0, place], urls, None


# ---- rules and elements -----------------------------------------------------------------------------------------


def touched() -> Column:
    """Whether a sheet or an attribute may give an element a background."""
    return (F.size("keys") > 0) | F.coalesce(F.lower(F.try_element_at("attrs", F.lit("style"))).contains("background"), F.lit(False))


def declarations(elems: DataFrame) -> DataFrame:
    """DECLARED: the background declarations of the sheets (parts: their selectors) and style attributes (no parts) of elements."""
    style, attribute = F.col("tag") == "style", lambda n: F.try_element_at("attrs", F.lit(n))
    kind = F.lower(F.trim(F.coalesce(attribute("type"), F.lit(""))))
    fine = F.when(style, F.lower("text").contains("background") & kind.isin("", "text/css")).otherwise(F.coalesce(F.lower(attribute("style")).contains("background"), F.lit(False)))
    rows = elems.where(fine).select("page_key", "root_no", "elem_ordinal", F.when(style, F.coalesce(attribute("media"), F.lit(""))).alias("media"), F.when(style, F.col("text")).otherwise(attribute("style")).alias("css"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_key", "root_no", "sheet", "sel", "rank", "found", "parts"]
        pack = lambda held: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], names)
        held: list[tuple] = []
        for batch in batches:
            for page, root, at, media, css in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if media is None:
                    found = _of_attribute(page, root, at, css)
                elif applies(media):
                    found = _of_sheet(page, root, at, css)
                else:
                    continue
                for row in found:
                    held.append(row)
                    if len(held) == RULE_ROWS:
                        yield pack(held)
                        held = []
        if held:
            yield pack(held)

    return rows.mapInArrow(run, DECLARED)


def _keyed(elems: DataFrame) -> DataFrame:
    """Elements by each of their keys that a sheet asks for."""
    words = F.filter(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"[ \t\n\f\r]+"), lambda w: w != "")
    attrs = F.map_filter("attrs", lambda k, v: k != "style")
    return elems.where(F.size("keys") > 0).select("page_key", "root_no", F.col("elem_ordinal").alias("at"), F.col("subtree_end").alias("last"), "parent", "tag", attrs.alias("attrs"), F.try_element_at("attrs", F.lit("id")).alias("own"), words.alias("words"), F.explode("keys").alias("key"))


def _tested(test: Column) -> Column:
    """Whether the element of a row passes one test of an attribute."""
    x, v = F.try_element_at("attrs", test["name"]), test["value"]
    some = v != ""
    how = {
        "has": x.isNotNull(), "=": x == v, "~=": F.array_contains(F.split(x, r"[ \t\n\f\r]+"), v) & some, "|=": (x == v) | x.startswith(F.concat(v, F.lit("-"))),
        "^=": x.startswith(v) & some, "$=": x.endswith(v) & some, "*=": F.contains(x, v) & some, "root": (F.col("tag") == "html") & (F.col("parent") < 0),
    }
    return F.coalesce(reduce(lambda out, h: F.when(test["how"] == h[0], h[1]).otherwise(out), how.items(), F.lit(False)), F.lit(False))


def _outermost(chain: DataFrame) -> DataFrame:
    """The elements of each selector that are inside no other of them, as intervals."""
    before = W.partitionBy(*RULE).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return chain.withColumn("_covered", F.max("last").over(before)).where("_covered is null or _covered < at").select(*RULE, F.col("at").alias("first"), "last")


def matched(elems: DataFrame, selectors: DataFrame) -> DataFrame:
    """RULE and at: the elements that each selector of declarations() names, each once."""
    parts = selectors.select(*RULE, F.size("parts").alias("n"), F.posexplode("parts").alias("k", "p")).select(*RULE, "n", "k", "p.*")
    parts = parts.withColumnsRenamed({"tag": "p_tag", "id": "p_id"})
    fits = (F.coalesce(F.col("p_tag") == F.col("tag"), F.col("p_tag").isNull())) & F.coalesce(F.col("p_id") == F.col("own"), F.col("p_id").isNull())
    fits &= (F.size(F.array_except("classes", "words")) == 0) & F.forall("tests", _tested)
    hits = _keyed(elems).join(parts, ["page_key", "root_no", "key"]).where(F.coalesce(fits, F.lit(False)))
    hits = stored(hits.select(*RULE, "n", "k", "comb", "at", "last", "parent"), "hits")
    chain, out, k = hits.where("k = 0"), [hits.where("k = 0 and n = 1")], 0
    while not hits.where(F.col("k") > k).isEmpty():  # as many steps as the longest selector has compounds
        k += 1
        more, keep = hits.where(F.col("k") == k), [*RULE, "n", "at", "last", "parent"]
        child = more.where("comb = '>'").join(chain.select(*RULE, F.col("at").alias("parent")), [*RULE, "parent"], "left_semi")
        beside = more.where("comb = '+'").join(chain.select(*RULE, "parent", (F.col("last") + 1).alias("at")), [*RULE, "parent", "at"], "left_semi")
        after = more.where("comb = '~'").join(chain.groupBy(*RULE, "parent").agg(F.min("at").alias("_first")), [*RULE, "parent"]).where("_first < at")
        below = T.enclosed(more.where("comb = ' '").withColumnRenamed("last", "end"), _outermost(chain), tuple(RULE)).where("first < at").drop("first", "last").withColumnRenamed("end", "last")
        chain = stored(reduce(DataFrame.unionByName, [x.select(*keep) for x in (child, beside, after, below)]), "chain")
        out.append(chain.where(F.col("n") == k + 1))
    return reduce(DataFrame.unionByName, [x.select(*RULE, "at") for x in out])


def cascaded(elems: DataFrame) -> DataFrame:
    """page_key, elem_ordinal, styled: the addresses of the declaration that decides an element's background; none for 'none' and colours.

    Elements without declarations have no row. A null or empty sheet declares nothing; without sheets the attributes alone
    decide. Equal ranks do not occur: a rank ends with the sheet's place and the declaration's place there.
    """
    found = stored(declarations(elems), "declared")
    sheets = found.where("parts is not null")
    by_rule = matched(elems, sheets).join(sheets.select(*RULE, "rank", "found"), RULE)
    inline = found.where("parts is null").select("page_key", F.col("sheet").alias("at"), "rank", "found")
    best = by_rule.select("page_key", "at", "rank", "found").unionByName(inline).groupBy("page_key", "at").agg(F.max(F.struct("rank", "found")).alias("b"))
    return best.select("page_key", F.col("at").alias("elem_ordinal"), F.col("b.found").alias("styled"))


def styled(elems: DataFrame) -> DataFrame:
    """elems with found as the cascade decides it; noscript elements keep theirs. Only elements that a declaration may touch are joined."""
    may = touched() & (F.col("tag") != "noscript")
    both = elems.where(may).join(cascaded(elems), ["page_key", "elem_ordinal"], "left")
    both = both.withColumn("found", F.coalesce("styled", F.array().cast("array<string>"))).drop("styled")
    return both.unionByName(elems.where(~may))


def sheet_backgrounds(elems: DataFrame) -> DataFrame:
    """page_key, page_id, elem_ordinal, sub_ordinal, src: the backgrounds that elements have by sheets and attributes."""
    named = elems.where(touched() & (F.col("tag") != "noscript")).select("page_key", "page_id", "url", "elem_ordinal")
    rows = cascaded(elems).where(F.size("styled") > 0).join(named, ["page_key", "elem_ordinal"])
    rows = rows.select("page_key", "page_id", "url", "elem_ordinal", F.posexplode("styled").alias("sub_ordinal", "raw"))
    return rows.select("page_key", "page_id", "elem_ordinal", "sub_ordinal", absolute(F.col("raw"), F.col("url")).alias("src"))
