"""Elements as intervals: selectors held as data, and joins of elements with what encloses them.

An element covers the ordinals from its own to its last descendant's. Whether one is inside another is then a comparison
of numbers, and the join of inner elements with the intervals around them is an equi-join on the page and on bins of
ordinals, with the comparison behind it: no list of ancestors is kept, and a page of many elements is spread over bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ordinals of a bin.
BIN = 256
#: A selector: alternatives, each a tag ("": any) and tests (attribute, how, value) that all hold.
Selector = tuple[tuple[str, tuple[tuple[str, str, str], ...]], ...]


def _holds(attribute: str, how: str, value: str) -> Column:
    x = F.try_element_at("attrs", F.lit(attribute))
    test = {
        "has": lambda: x.isNotNull(),
        "is": lambda: x == value,
        "word": lambda: F.array_contains(F.split(x, r"[ \t\n\f\r]+"), value),
        "begins": lambda: x.startswith(value),
        "holds": lambda: F.contains(x, F.lit(value)),
        "holds, in any case": lambda: F.contains(F.lower(x), F.lit(value.lower())),
    }[how]()
    return F.coalesce(test, F.lit(False))


def selected(selector: Selector) -> Column:
    """Whether a row of elements is one that the selector names."""
    one = lambda tag, tests: reduce(lambda a, b: a & b, [F.col("tag") == tag] * bool(tag) + [_holds(*t) for t in tests])
    return reduce(lambda a, b: a | b, [one(tag, tests) for tag, tests in selector])


def hits(elems: DataFrame, selectors: dict[str, Selector]) -> DataFrame:
    """name, and the element, for every element and every selector that names it."""
    names = F.array_compact(F.array(*[F.when(selected(s), F.lit(n)) for n, s in selectors.items()]))
    return elems.select(F.explode(names).alias("name"), "page_key", "root_no", "doc_no", "elem_ordinal", "parent", "subtree_end", "tag", "attrs", "text")


def enclosed(inner: DataFrame, outer: DataFrame, key: tuple[str, ...] = ("page_key",), size: int = BIN) -> DataFrame:
    """inner (key, at, …) joined with outer (key, first, last, …): every interval that holds at, its own included.

    Columns other than the key must differ. A null at or key joins with nothing; empty tables: no rows.
    """
    bin_of = lambda c: F.floor(F.col(c) / size).cast("int")
    left = inner.withColumn("_bin", bin_of("at"))
    right = outer.withColumn("_bin", F.explode(F.sequence(bin_of("first"), bin_of("last"))))
    return left.join(right, [*key, "_bin"]).where((F.col("first") <= F.col("at")) & (F.col("at") <= F.col("last"))).drop("_bin")


def intervals(elems: DataFrame, *columns) -> DataFrame:
    """elems as intervals: page_key, first, last, and columns."""
    return elems.select("page_key", F.col("elem_ordinal").alias("first"), F.col("subtree_end").alias("last"), *columns)


def places(elems: DataFrame, *columns) -> DataFrame:
    """elems as what may be inside of intervals: page_key, at, and columns."""
    return elems.select("page_key", F.col("elem_ordinal").alias("at"), *columns)
