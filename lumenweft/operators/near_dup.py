"""Perceptual hashes, pairs within a Hamming distance, complete-linkage groups and their keepers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.sources.shared import stored

SIDE, LOW, BITS = 32, 8, 64
DEFAULT_THRESHOLD = 8
MOST_BANDED = 9  # beyond it two bands are so few bits that a join on them costs more than comparing all
BLOCK, TILE = 16_384, 8
FOUND = 1_000_000  # pairs that a task hands over at once
_BASIS = np.cos(np.pi / SIDE * (np.arange(SIDE)[None, :] + 0.5) * np.arange(LOW)[:, None])


def perceptual_hash(gray: np.ndarray) -> np.ndarray:
    """n x 1024 luma values -> n x 64 bits: the low 8 x 8 DCT coefficients over the median of all but the first."""
    if gray.shape[1] != SIDE * SIDE:
        raise ValueError(f"a hash takes {SIDE * SIDE} samples, not {gray.shape[1]}")
    low = _BASIS @ gray.reshape(-1, SIDE, SIDE) @ _BASIS.T
    flat = low.reshape(-1, LOW * LOW)
    return flat > np.median(flat[:, 1:], axis=1, keepdims=True)


def hashed(images: DataFrame, gray: str = "gray") -> DataFrame:
    """images plus p_hash, 16 hexadecimal digits; null where gray is null. Arrow batches of a matrix product."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series([None] * len(values), dtype=object)
        if known.any():
            bits = perceptual_hash(np.stack([np.asarray(v, np.float64) for v in values[known]]))
            out[known.to_numpy()] = [np.packbits(b).tobytes().hex() for b in bits]
        return out

    return images.withColumn("p_hash", run(F.col(gray)))


def luma(r, g, b):
    return 0.299 * r + 0.587 * g + 0.114 * b


def bits_of(p_hash: Column) -> Column:
    """A hash's two halves as whole numbers."""
    half = lambda at: F.conv(F.substring(p_hash, at, 8), 16, 10).cast("bigint")
    return F.struct(half(1).alias("hi"), half(9).alias("lo"))


def _whole() -> Column:
    return F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))


def _block_pairs(hashes: DataFrame, threshold: int) -> DataFrame:
    """near_pairs() by comparing all hashes: rows are dealt into blocks, and every two blocks are one small group of their own.

    The work grows with the square of the rows, by a few nanoseconds a pair; a task holds two blocks and hands over
    what is near in them a part at a time, as in blocks of copies all pairs are.
    """
    rows = stored(hashes.select("seq", _whole().alias("h")).where("seq is not null and h is not null"), "hashes")
    n = max(1, -(-rows.count() // BLOCK))
    dealt = rows.select("seq", "h", F.pmod(F.xxhash64("seq"), F.lit(n)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    dealt = dealt.select(F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("first"), "seq", "h")

    def batch(found: list[tuple]) -> pa.RecordBatch:
        a, b, distance = (np.concatenate(v) for v in zip(*found, strict=True))
        kept = a != b
        return pa.RecordBatch.from_arrays([pa.array(v[kept]) for v in (a, b, distance)], ["a", "b", "distance"])

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        seq, h, first = (rows[c].to_numpy() for c in ("seq", "h", "first"))
        h, first = h.view(np.uint64), first.astype(bool)
        one = key[0].as_py() == key[1].as_py()
        (x, hx), (y, hy) = ((seq[side], h[side]) for side in (first, first if one else ~first))
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))
        found, size = [none], 0
        for at in range(0, len(x), TILE):
            begin = at if one else 0
            apart = np.bitwise_count(hx[at : at + TILE, None] ^ hy[None, begin:])
            near = np.flatnonzero(apart <= threshold)
            r, c = np.divmod(near, max(1, apart.shape[1]))
            if one:  # every two rows of the block once
                r, c = r[r < c], c[r < c]
            if r.size:
                a, b = x[at + r], y[begin + c]
                found.append((np.minimum(a, b), np.maximum(a, b), apart[r, c].astype(np.int32)))
                size += r.size
            if size >= FOUND:
                yield batch(found)
                found, size = [none], 0
        yield batch(found)

    return dealt.repartition(min(n * (n + 1) // 2, 4096), "i", "j").groupBy("i", "j").applyInArrow(compare, "a bigint, b bigint, distance int")


def near_pairs(hashes: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """hashes (seq, hi, lo) -> (a, b, distance), a < b, within the threshold.

    Two hashes that differ in t bits at most agree on two or more of t + 2 disjoint bands, so an equi-join on pairs of
    bands misses none and meets far fewer strangers than one on single bands. A pair is emitted by the first two bands
    on which it agrees, so no distinct is needed. Give each hash once; see clusters() for rows that share one.
    Larger thresholds compare blocks of hashes instead.
    """
    if threshold > MOST_BANDED:
        return _block_pairs(hashes, threshold)
    n = threshold + 2
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    table = [(BITS - b, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    spec = F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(m).cast("bigint").alias("mask")) for s, m in table])
    twos = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(i + 1, n)])
    rows = hashes.select("seq", _whole().alias("h"))
    rows = rows.withColumn("bands", F.transform(spec, lambda c: F.call_function("shiftrightunsigned", F.col("h"), c["shift"]).bitwiseAND(c["mask"])))
    keys = F.transform(twos, lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"), F.get("bands", c["i"]).alias("v"), F.get("bands", c["j"]).alias("w")))
    keyed = rows.select("seq", "h", "bands", F.explode(keys).alias("k")).select("seq", "h", "bands", "k.*")
    key = ["i", "j", "v", "w"]
    x, y = (keyed.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("seq", "h", "bands")]) for s in "ab")
    distance = F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b")))
    pairs = x.join(y, key).where((F.col("seq_a") < F.col("seq_b")) & (distance <= threshold))
    agree = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.get("bands_a", t) == F.get("bands_b", t))
    return pairs.where((F.get(agree, F.lit(0)) == F.col("i")) & (F.get(agree, F.lit(1)) == F.col("j"))).select(F.col("seq_a").alias("a"), F.col("seq_b").alias("b"), distance.alias("distance"))


def labelled(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq, label): the least seq of each node's component of the graph of pairs. Labels double their reach each round."""
    both = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "adjacent")
    labels = stored(nodes.select("seq", F.col("seq").alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("seq", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen, labels["seq"] == seen["a"], "left").select("seq", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        jump = near.select(F.col("seq").alias("label"), F.col("label").alias("further"))
        new = stored(near.join(jump, "label", "left").select("seq", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("seq", "label")
        labels = new.select("seq", "label")


def clusters(hashes: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """hashes (seq, hi, lo) -> (seq, cluster): complete linkage, greedy in order of seq; cluster is its first member's seq.

    Rows of one hash are one member, as they are always of one group. No group reaches over a component of the graph of
    near pairs, so greedy within each component, in order, is greedy over all. A component whose members all are
    near to each other is decided by its number of pairs; only others are folded in one task, two numbers a hash.
    """
    each = stored(hashes.groupBy("hi", "lo").agg(F.min("seq").alias("seq")), "hashes")
    near = stored(near_pairs(each, threshold), "near")
    # what is near to nothing is a group of its own and takes no part in the rounds
    linked = near.select(F.explode(F.array("a", "b")).alias("seq")).distinct()
    parts = labelled(linked, near).join(each.hint("merge"), "seq")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        found: list[tuple[int, list[tuple[int, int]]]] = []
        out = []
        for seq, hi, lo in zip(rows["seq"], rows["hi"], rows["lo"], strict=True):
            h = (int(hi) << 32) | int(lo)
            for first, members in found:
                if all((h ^ m).bit_count() <= threshold for m in members):
                    members.append(h)
                    out.append(first)
                    break
            else:
                found.append((seq, [h]))
                out.append(seq)
        return pd.DataFrame({"seq": rows["seq"], "cluster": out})

    many = W.partitionBy("label")
    sized = parts.withColumn("_n", F.count(F.lit(1)).over(many))
    # of two hashes, and of any number that are all near to each other, the first one's group has all
    full = parts.select("seq", "label").join(near, F.col("seq") == F.col("a")).groupBy("label").agg(F.count(F.lit(1)).alias("_pairs"))
    sized = sized.join(full, "label", "left").withColumn("_whole", F.coalesce("_pairs", F.lit(0)) * 2 == F.col("_n") * (F.col("_n") - 1))
    plain = sized.where("_whole").select("seq", F.col("label").alias("cluster"))
    found = plain.unionByName(sized.where("not _whole").groupBy("label").applyInPandas(greedy, "seq bigint, cluster bigint"))
    decided = each.join(found.hint("merge"), "seq", "left").select("hi", "lo", F.coalesce("cluster", "seq").alias("cluster"))
    return hashes.select("seq", "hi", "lo").join(decided.hint("merge"), ["hi", "lo"]).select("seq", "cluster")


def keepers(items: DataFrame) -> DataFrame:
    """items (seq, cluster, width, height, file_size) plus near_duplicate and duplicate_group: the keeper of each group of two or more is its largest."""
    area = F.coalesce(F.col("width"), F.lit(0)).cast("bigint") * F.coalesce(F.col("height"), F.lit(0))
    rank = F.struct(area.alias("area"), F.coalesce(F.col("file_size"), F.lit(0)).alias("size"), (-F.col("seq")).alias("first"))
    best = items.groupBy("cluster").agg(F.count(F.lit(1)).alias("_size"), F.max_by("seq", rank).alias("_keeper"))
    out = items.join(best, "cluster").select(*items.columns, "_size", "_keeper")
    return out.withColumn("near_duplicate", (F.col("_size") > 1) & (F.col("seq") != F.col("_keeper"))).withColumn("duplicate_group", F.when(F.col("_size") > 1, F.col("_keeper"))).drop("_size", "_keeper")
