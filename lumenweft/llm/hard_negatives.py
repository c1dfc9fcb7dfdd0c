"""Hard-negative mining over a table of pivot distances.

With M the largest norm of all vectors, x' = (x, sqrt(M^2 - |x|^2)) and an anchor q' = (q, 0), the inner product is
q.x = (|q|^2 + M^2 - |q' - x'|^2) / 2: it falls as the Euclidean distance grows. A few pivots are chosen, and the
distance of every vector to every pivot is stored once. For an anchor the triangle inequality then brackets each
distance, so each score, by the stored distances alone; only vectors whose bracket reaches what is asked for are
checked exactly.

An anchor's positives are the best vectors of its own label. Each positive's score opens a band of scores, and its
negatives are the best vectors of other labels in that band: brackets that miss all bands of the anchor go, and those
that cannot come before the last of as many negatives as are wanted.

Vectors are dealt into shards by a hash, never by label, so a common label or a vector that many rows share makes no
large shard. Anchors come in blocks, and each pair of a shard and a block is one group. An anchor is first searched in
one shard; the last score that it needs from there goes with it to all other shards, which then return what beats it.

The scores are whole numbers and exact: doubles where all sums stay below 2^53, else 64-bit, else Python's integers; a
score beyond 64 bits is given as the end of their range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.llm._common import stored, table
from lumenweft.llm.topk import HIGHEST, LEAST_SHARD_ROWS, LOWEST, QUERY_ROWS, SHARD_ROWS, quantised

PIVOTS = 16
#: Pivots are chosen among so many rows, those of the least hashes. It bounds the driver's memory, not the index: every row is in the table.
PIVOT_SAMPLE = 2048
POSITIVES = NEGATIVES = 5
#: The band of negative scores as parts of a positive score: LOW_PART * p <= WHOLE * n <= HIGH_PART * p.
LOW_PART, HIGH_PART, WHOLE = 80, 100, 100
TABLE = "vec_id bigint, label int, q array<bigint>, norm2 double, pd array<double>"


def labelled(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: float = 256.0) -> DataFrame:
    """vec_id, label, q: rows with an id, a label and a vector of finite parts; floor(scale * x) as in topk.quantised()."""
    own = F.col(label) if isinstance(label, str) else label
    return quantised(vectors, scale, vec_id, vector, keep={"label": own.cast("int")}).where("label is not null").select("vec_id", "label", "q")


def _padded(values: list, dims: int) -> np.ndarray:
    out = np.zeros((len(values), dims), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _lifted(x: np.ndarray, norm2: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the one part more that gives all of them the norm sqrt(most)."""
    return np.concatenate([x, np.sqrt(np.maximum(most - norm2, 0))[:, None]], 1)


def choose_pivots(sample: np.ndarray, most: float, pivots: int = PIVOTS) -> np.ndarray:
    """Farthest-first among the lifted rows of the sample; fewer if the sample has fewer places."""
    lifted = _lifted(sample, (sample**2).sum(1), most)
    chosen = [0] if len(lifted) else []
    away = np.full(len(lifted), np.inf)
    while chosen and len(chosen) < pivots:
        away = np.minimum(away, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
        if not away.max() > 0:
            break
        chosen.append(int(away.argmax()))
    return lifted[chosen]


def pivot_table(rows: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> tuple[DataFrame, np.ndarray, float]:
    """(vec_id, label, q, norm2 and pd, the distances to the pivots; the pivots; the largest squared norm). Stored."""
    rows = stored(rows, "labelled")
    square = F.aggregate("q", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    most, dims = rows.agg(F.max(square), F.max(F.size("q"))).first()
    some = rows.select("vec_id", "q").orderBy(F.xxhash64("vec_id", "q"), "vec_id").limit(sample).collect()
    dims, most = dims or 0, most or 0.0
    table_of = choose_pivots(_padded([r["q"] for r in some], dims).astype(np.float64), most, pivots)

    def run(frames):
        for f in frames:
            x = _padded(list(f["q"]), dims).astype(np.float64)
            norm2 = (x**2).sum(1)
            lifted = _lifted(x, norm2, most)
            pd_ = np.stack([np.sqrt(((lifted - p) ** 2).sum(1)) for p in table_of], 1) if len(f) else np.zeros((0, len(table_of)))
            yield pd.DataFrame({"vec_id": f["vec_id"], "label": f["label"], "q": f["q"], "norm2": norm2, "pd": list(pd_)})

    return stored(rows.mapInPandas(run, TABLE), "pivots"), table_of, most


class Shard:
    """The vectors of one shard, those of one label side by side and each label's in the order of their ids."""

    def __init__(self, rows: pd.DataFrame, pivots: np.ndarray, most: float, peak: float = 0.0) -> None:
        rows = rows.sort_values(["label", "vec_id"], kind="stable")
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.dims = pivots.shape[1] - 1 if len(pivots) else 0
        x = _padded(list(rows["q"]), self.dims)
        peak = max(peak, float(np.abs(x.astype(np.float64)).max(initial=0)))
        self.kind = np.float64 if peak * peak * max(self.dims, 1) < 2.0**53 else np.int64 if peak * peak * max(self.dims, 1) < 2.0**62 else object
        self.x = x.astype(self.kind)
        self.far = np.stack(list(rows["pd"])) if len(rows) else np.zeros((0, len(pivots)))
        self.pivots, self.most = pivots, most
        self.checked = self.seen = 0  # exact checks, and vectors that were candidates

    def bracket(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that the stored distances allow for each vector."""
        qf = q.astype(np.float64)
        norm2 = float((qf**2).sum())
        own = np.sqrt(((self.pivots - np.append(qf, 0.0)) ** 2).sum(1))
        near = np.abs(self.far - own).max(1)
        wide = (self.far + own).min(1)
        slack = (norm2 + self.most) * 1e-9 + 1e-6  # distances are rounded
        both = norm2 + self.most
        return (both - wide**2) / 2 - slack, (both - near**2) / 2 + slack

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.checked += len(at)
        s = self.x[at] @ q.astype(self.kind)
        return np.array([min(max(int(v), LOWEST), HIGHEST) for v in s], np.int64) if self.kind is object else s.astype(np.int64)

    def of_label(self, label: int) -> slice:
        return slice(np.searchsorted(self.labels, label, "left"), np.searchsorted(self.labels, label, "right"))

    def best(self, q: np.ndarray, own: int, label: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(id, score) of the k best of the label but for the anchor's own id; not below the floor, if there is one."""
        part = self.of_label(label)
        at = np.arange(part.start, part.stop)
        at = at[self.ids[at] != own]
        self.seen += len(at)
        if not len(at):
            return []
        high = self.bracket(q)[1][at] if len(at) > 4 * k or floor is not None else np.full(len(at), np.inf)
        if len(at) > 4 * k:
            first = np.argpartition(-high, 2 * k)[: 2 * k]
            kth = int(np.sort(self.scores(at[first], q))[-k])
            floor = kth if floor is None else max(floor, kth)
        if floor is not None:
            at = at[high >= floor]
        return _first(self.ids[at], self.scores(at, q), k, floor)

    def in_bands(self, q: np.ndarray, label: int, bands: list[tuple[int, int, int | None]], k: int) -> list[list[tuple[int, int]]]:
        """For each band (least, greatest, floor): (id, score) of the k best of other labels in it, not below the floor."""
        part = self.of_label(label)
        at = np.concatenate([np.arange(0, part.start), np.arange(part.stop, len(self.ids))])
        self.seen += len(at)
        low, high = self.bracket(q)
        bottoms = [b if f is None else max(b, f) for b, _, f in bands]
        at = at[(high[at] >= min(bottoms)) & (low[at] <= max(t for _, t, _ in bands))]
        if len(at) > 16 * k:  # a first part gives each band a floor of its own
            first = np.argpartition(-high[at], 8 * k)[: 8 * k]
            s = self.scores(at[first], q)
            for i, (b, t, _) in enumerate(bands):
                inside = np.sort(s[(s >= b) & (s <= t)])
                if len(inside) >= k:
                    bottoms[i] = max(bottoms[i], int(inside[-k]))
            at = at[high[at] >= min(bottoms)]
        s, ids = self.scores(at, q), self.ids[at]
        out = []
        for bottom, (_, top, _) in zip(bottoms, bands, strict=True):
            inside = (s >= bottom) & (s <= top)
            out.append(_first(ids[inside], s[inside], k, None))
        return out


def _first(ids: np.ndarray, scores: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
    """The k first by score, highest first, and then by id."""
    if floor is not None:
        keep = scores >= floor
        ids, scores = ids[keep], scores[keep]
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return [(int(ids[i]), int(scores[i])) for i in order]


def band(positive: int, low: int = LOW_PART, high: int = HIGH_PART, whole: int = WHOLE) -> tuple[int, int]:
    """The whole scores n with low * positive <= whole * n <= high * positive, as (least, greatest); empty if least is greater."""
    return -(-low * positive // whole), high * positive // whole


def _searched(left: DataFrame, right: DataFrame, find, pivots: np.ndarray, most: float, schema: str) -> DataFrame:
    """What find(shard, anchors) yields in each group of vectors (shard, block, ..) and anchors (shard, block, ..)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def group(vectors: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or anchors.empty:
            return pd.DataFrame([], columns=names)
        q = _padded(list(anchors["q"]), pivots.shape[1] - 1)
        shard = Shard(vectors, pivots, most, float(np.abs(q.astype(np.float64)).max(initial=0)))
        found = [row for i, a in enumerate(anchors.itertuples(index=False)) for row in find(shard, q[i], a)]
        return pd.DataFrame(found, columns=names)

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(group, schema)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, band_parts: tuple[int, int, int] = (LOW_PART, HIGH_PART, WHOLE), shard_rows: int = SHARD_ROWS, anchor_rows: int = QUERY_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    rows, anchors: (vec_id, label, q) as from labelled(); anchors are some of rows. A positive is one of an anchor's
    `positives` best rows of its label with another id; a negative one of the `negatives` best rows of other labels whose
    scores are in the positive's band. Higher scores come first, ties by smaller id; fewer rows than asked for: all.
    Rows that repeat an id count each, an anchor's id that repeats answers once (for its least label and vector).
    Positives without negatives leave no row. Vectors of fewer dimensions count as filled up with zeros. Empty tables: no rows.
    """
    spark = rows.sparkSession
    vectors, pivots, most = pivot_table(rows)
    anchors = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("a")).select("vec_id", "a.label", "a.q")
    if not len(pivots):
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    n, m = vectors.count(), anchors.count()
    shards = max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, n // LEAST_SHARD_ROWS))
    dealt = lambda ids, parts, seed: F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    home, shard = dealt(["vec_id"], shards, 3), dealt(["vec_id", "q"], shards, 1)

    def in_all(asked: DataFrame, floored, find, schema: str, tag: str) -> DataFrame:
        """First each anchor in its own shard, then, with the floors that this gives, in all others."""
        grouped = lambda blocks: vectors.select(shard.alias("shard"), every(blocks).alias("block"), "vec_id", "label", "q", "pd")
        blocks = max(1, -(-m // (shards * anchor_rows)))
        first = asked.select(home.alias("shard"), dealt(["vec_id"], blocks, 2).alias("block"), "*")
        found = stored(_searched(grouped(blocks), first, find, pivots, most, schema), tag)
        if shards == 1:
            return found
        blocks = max(1, -(-m // anchor_rows))
        rest = floored(asked, found).select(every(shards).alias("shard"), dealt(["vec_id"], blocks, 2).alias("block"), "*").where(F.col("shard") != home)
        return found.unionByName(_searched(grouped(blocks), rest, find, pivots, most, schema))

    # Positives. Scores and floors travel as text: a column of whole numbers with nulls would become doubles.
    def near(s: Shard, q: np.ndarray, a) -> list[tuple]:
        return [(a.vec_id, i, v) for i, v in s.best(q, a.vec_id, a.label, positives, None if a.floor is None else int(a.floor))]

    def near_floors(asked: DataFrame, found: DataFrame) -> DataFrame:
        floors = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("c"), F.min("score").cast("string").alias("floor")).where(F.col("c") >= positives)
        return asked.drop("floor").join(floors.drop("c"), "vec_id", "left")

    asked = stored(anchors.withColumn("floor", F.lit(None).cast("string")), "anchors")
    found = in_all(asked, near_floors, near, "anchor_id bigint, positive_id bigint, score bigint", "near")
    best = W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    kept = found.withColumn("p", F.row_number().over(best)).where(F.col("p") <= positives)

    # Negatives. An anchor goes with the scores of its positives; bands without whole numbers are left out.
    low, high, whole = band_parts
    score = F.col("score").cast("decimal(38,0)")
    kept = stored(kept.where(F.lit(low) * score <= F.lit(high) * score), "positives")
    per_anchor = kept.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("p", F.col("score").cast("string").alias("score"), F.lit(None).cast("string").alias("floor")))).alias("bands"))
    asked = stored(asked.drop("floor").join(per_anchor, "vec_id"), "banded")

    def hard(s: Shard, q: np.ndarray, a) -> list[tuple]:
        bands = [(b["p"], *band(int(b["score"]), low, high, whole), None if b["floor"] is None else int(b["floor"])) for b in a.bands]
        bands = [b for b in bands if b[1] <= b[2]]
        if not bands:
            return []
        return [(a.vec_id, b[0], i, v) for b, got in zip(bands, s.in_bands(q, a.label, [b[1:] for b in bands], negatives), strict=True) for i, v in got]

    def hard_floors(asked: DataFrame, found: DataFrame) -> DataFrame:
        full = found.groupBy("anchor_id", "p").agg(F.count(F.lit(1)).alias("c"), F.min("score").cast("string").alias("floor")).where(F.col("c") >= negatives)
        floors = full.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("p", "floor"))).alias("floors"))
        put = F.transform("bands", lambda b: F.struct(b["p"].alias("p"), b["score"].alias("score"), F.element_at("floors", b["p"]).alias("floor")))
        return asked.join(floors, "vec_id", "left").withColumn("bands", F.when(F.col("floors").isNull(), F.col("bands")).otherwise(put)).drop("floors")

    found = in_all(asked, hard_floors, hard, "anchor_id bigint, p int, negative_id bigint, score bigint", "hard")
    best = W.partitionBy("anchor_id", "p").orderBy(F.desc("score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).withColumnRenamed("score", "negative_score")
    out = ranked.join(kept.withColumnRenamed("score", "positive_score"), ["anchor_id", "p"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = labelled(table(spark, sf_dir, "embeddings"), label=wrong)
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op12_pivot_negatives": op12_pivot_negatives}
ORACLES = {
    "op12_pivot_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {LOW_PART} * positive_score <= {WHOLE} * s.score AND {WHOLE} * s.score <= {HIGH_PART} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
}
