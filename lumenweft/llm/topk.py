"""Exact top-k inner-product search by columnar branch and bound.

The vectors are dealt into shards of a bounded number of rows, and each shard is laid out by dimension. For a query,
scores accumulate over one block of dimensions after another. After each block the mass that remains (the norm of the
query's and of the candidate's dimensions still to come) bounds how far a score can move; candidates whose upper bound
lies below the k-th highest lower bound go, and the survivors' columns are compacted before the next block.

The queries come in blocks of a bounded size; each pair of a query block and a shard is one group, so a task never
holds more than one of both, whatever the size of the table. First each query is searched in one shard only; the k-th
best score found there goes with it to all other shards, where it prunes from the first block on. Per group at most k
rows a query leave, and a window picks the k best of them. Vectors are copied once for each query block of QUERY_ROWS.

Whole-number scores are exact: where 64-bit sums could overflow, Python's integers add up. A score beyond 64 bits is
given as the end of their range that it lies beyond; among such equal scores the smaller id is the better.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.llm._common import stored, table

SHARD_ROWS = 65_536
QUERY_ROWS = 32_768
#: Shards are smaller than SHARD_ROWS, but no smaller than this, until there is one for each core.
LEAST_SHARD_ROWS = 2048
DIM_BLOCK = 16
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", keep: dict[str, Column] | None = None) -> DataFrame:
    """vec_id, q array<bigint>: floor(scale * x), x as double, at the ends of 64 bits if beyond them; and what keep names.

    Vectors null or with null or non-finite parts, or a null id, go.
    """
    x = F.col("v").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"), *[c.alias(name) for name, c in (keep or {}).items()]).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    return rows.where(fine).select("vec_id", *(keep or {}), F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("bigint")).alias("q"))


def _matrix(values: list, dims: int) -> np.ndarray:
    out = np.zeros((dims, len(values)), np.int64)
    for i, v in enumerate(values):
        out[: len(v), i] = v
    return out


def search_shard(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, floors: list[int | None] | None = None, block: int = DIM_BLOCK) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best in one shard; columns is dimensions x vectors, ids ascend.

    Ties go to the smaller id; a query's own id is no candidate. Equal ids are candidates each. A query's floor, if it
    has one, is the k-th best score known from elsewhere: lower ones are left out.
    """
    dims, n = columns.shape
    cuts = [*range(0, dims, block), dims]
    peak = max((float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (queries, columns)), default=0.0)
    exact = peak * peak * max(dims, 1) < 2.0**62
    if not exact:
        queries, columns = queries.astype(object), columns.astype(object)
    floats = columns.astype(np.float64)
    rest = np.zeros((len(cuts), n))  # rest[j]: norm of the dimensions from cut j on
    for j in range(len(cuts) - 2, -1, -1):
        rest[j] = rest[j + 1] + (floats[cuts[j] : cuts[j + 1]] ** 2).sum(0)
    rest = np.sqrt(rest)
    parts = [np.ascontiguousarray(columns[a:b].T) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for c, own in enumerate(query_ids):
        q = queries[:, c]
        qf = q.astype(np.float64)
        known = None if floors is None else floors[c]
        alive = np.flatnonzero(ids != own)
        score = np.zeros(len(alive), columns.dtype)
        for j, part in enumerate(parts):
            a, b = cuts[j], cuts[j + 1]
            if known is not None or len(alive) > 4 * k:  # what is left from cut j on bounds the score
                slack = rest[j][alive] * np.sqrt((qf[a:] ** 2).sum()) * (1 + 1e-9) + 1e-6
                partial = score.astype(np.float64)
                spare = np.abs(partial) * 1e-12  # the sums are rounded to doubles here only
                floor = -np.inf if known is None else float(known)
                if len(alive) > 4 * k:
                    low = partial - slack - spare
                    floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
                floor = min(floor, float(HIGHEST))
                keep = partial + slack + spare >= floor - abs(floor) * 1e-12
                alive, score = alive[keep], score[keep]
            score = score + (part if len(alive) == n else part[alive]) @ q[a:b]
        if not exact:
            score = np.array([min(max(x, LOWEST), HIGHEST) for x in score], object)
        if known is not None:
            keep = np.flatnonzero(score >= known)
            alive, score = alive[keep], score[keep]
        if len(alive) > k and exact:
            floor = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= floor
            alive, score = alive[keep], score[keep]
        best = sorted(range(len(alive)), key=lambda i: (-int(score[i]), ids[alive[i]]))[:k]
        out.extend((int(own), int(ids[alive[i]]), int(score[i])) for i in best)
    return out


def _found(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, shard: the k best of each group of vectors (shard, block, ..) for its queries (.., floor)."""

    def group(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score", "shard"]
        if candidates.empty or asked.empty:
            return pd.DataFrame([], columns=names)
        candidates = candidates.sort_values("vec_id", kind="stable")
        dims = max(max(map(len, candidates["q"])), max(map(len, asked["q"])))
        floors = [None if f is None else int(f) for f in asked["floor"]]
        found = search_shard(_matrix(list(asked["q"]), dims), asked["vec_id"].to_numpy(), _matrix(list(candidates["q"]), dims), candidates["vec_id"].to_numpy(), k, floors)
        return pd.DataFrame([(*f, candidates["shard"].iloc[0]) for f in found], columns=names)

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(group, "query_id bigint, vec_id bigint, score bigint, shard int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products with the vectors of other ids.

    vectors, queries: (vec_id, q array<bigint>), as from quantised(). Fewer candidates than k: all. Vectors of fewer
    dimensions count as filled up with zeros. Rows that repeat an id are candidates each; a query id that repeats
    answers once. Scores beyond 64 bits: the end of their range. Empty tables: no rows.
    """
    spark = vectors.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    n, m = vectors.count(), queries.count()
    shards = max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, n // LEAST_SHARD_ROWS))
    # Shards by hash are a little uneven; some more of them keep the largest near the bound.
    dealt = lambda ids, parts, seed: F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    shard = dealt(["vec_id", "q"], shards, 1)

    def grouped(blocks: int) -> DataFrame:
        return vectors.select(shard.alias("shard"), every(blocks).alias("block"), "vec_id", "q")

    # One shard for each query first.
    blocks = max(1, -(-m // (shards * query_rows)))
    first = queries.select(dealt(["vec_id"], shards, 3).alias("shard"), dealt(["vec_id"], blocks, 2).alias("block"), "vec_id", "q", F.lit(None).cast("string").alias("floor"))
    seeds = stored(_found(grouped(blocks), first, k), "seeds")
    found = seeds
    if shards > 1:
        floors = seeds.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("c"), F.min("score").cast("string").alias("floor")).where(F.col("c") >= k).select("vec_id", "floor")
        blocks = max(1, -(-m // query_rows))
        asked = stored(queries.join(floors, "vec_id", "left"), "asked").select(every(shards).alias("shard"), dealt(["vec_id"], blocks, 2).alias("block"), "vec_id", "q", "floor")
        found = found.unionByName(_found(grouped(blocks), asked.where(F.col("shard") != dealt(["vec_id"], shards, 3)), k))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(q, q.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op7_columnar_topk": op7_columnar_topk}
ORACLES = {
    "op7_columnar_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5"""
}
