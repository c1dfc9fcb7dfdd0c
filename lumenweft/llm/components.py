"""Connected components of a table of links: alternating large and small stars, or one task where the links are few."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm._common import stored


def _star(adjacent: DataFrame, large: bool) -> DataFrame:
    """adjacent (u, v) -> edges (v, m): neighbours of u tied to the least of u and its neighbours.

    A hub's neighbours are never gathered: the least comes from a partial aggregation and goes back by a join.
    """
    least = adjacent.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = adjacent.join(least, "u")
    if large:
        return tied.where("v > u").select("v", "m")
    return tied.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))


#: Up to so many links one task joins them (two whole numbers each); beyond, stars do, however many there are.
FEW_LINKS = 300_000


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over all links of one task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for f in frames:
        for v, m in zip(f["v"].tolist(), f["m"].tolist(), strict=True):
            a, b = find(v), find(m)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root) for every node that is linked to another and is not itself the least of its component.

    Nulls and links of a node to itself go. No links: no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    edges = stored(edges, "edges")
    if edges.count() <= FEW_LINKS:
        return stored(edges.repartition(1).mapInPandas(_joined, "node bigint, root bigint"), "roots")
    state = None
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(edges.select(F.col("m").alias("u"), "v"))
        large = _star(both, True).where("v <> m").distinct()
        small = _star(large.select(F.col("v").alias("u"), F.col("m").alias("v")), False).where("v <> m").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("v").alias("node"), F.col("m").alias("root"))
        state = now
