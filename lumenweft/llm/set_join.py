"""N-gram Jaccard join with set-relation skipping.

Exact self-join of word-shingle sets at a Jaccard threshold, down to its connected components:

1. Equal sets become one class; only its representative (the smallest doc_id) goes on.
2. Prefix index: under one global order of the shingles (common ones last), two similar sets share a shingle among the
   first n - ceil(t n) + 1 of each. The index has an entry (shingle, set, size, position) for each of these.
3. Answers from a similar set: every set of an index list is compared with the list's leader only. Sets found similar
   to it take over its component; from then on no two sets of one component are compared, whatever their number. The
   round is repeated with other leaders while many pairs of different components are left and their number halves.
4. Index-level skipping: what remains are pairs of sets in different components. Of the sets that are similar to one
   model, a list keeps one entry. The lists are cut into blocks by size and by position; a pair of blocks is skipped
   when the sizes differ too much, when the positions leave too little to share, or when both blocks lie in one
   component; only in the other pairs entries meet.
5. Derived answers: the models of a pair of groups are compared. Where they are similar, the groups are one component.
   Where they are not and still lie in different components, the answers of a model's sets follow from what the models
   share and what each set has beyond its model: of the pairs that meet in the lists of the sets themselves, only those
   for which this sum leaves room are compared.
6. Candidates pass a bound (shingles counted in 64 classes: the sum of the lesser counts is the most that two sets can
   share) and are then compared in full, on sets made anew from the texts of those documents alone.

The order of the shingles only decides the work, never the result. So the common ones are counted within stretches of
each task's documents (a shingle that never repeats within any is not common), and a table of a fixed size holds the
most common ones. Shingles are 64-bit hashes of their words' 64-bit hashes; classes are
told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm._common import release, small_batches, sized, spread_join, stored, table, text_of
from lumenweft.llm.components import components

#: Size of the table of common shingles (8 MB), and from how many sets on a shingle may be in it.
COMMON_SHINGLES = 1 << 20
COMMON_FROM = 4
#: Shingles of a stretch of documents within which a task counts (8 bytes each).
STRETCH = 1_000_000
#: Entries of a block of an index list.
BLOCK_ENTRIES = 256
#: Blocks of a list that one task compares with all of its blocks.
LIST_BLOCKS = 64
SKETCH = 64
#: Up to so many pairs of blocks they are broadcast to the entries.
BROADCAST_BLOCKS = 100_000
MAX_ROUNDS = 6


# ---- sets of one text -------------------------------------------------------------------------------------------
def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z lower-cased; fewer words: one hash of all; no words: none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    with np.errstate(over="ignore"):
        x = h[: len(h) - n + 1] + np.uint64(n)
        for j in range(1, n):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
    return np.unique(x)


class Threshold:
    """A Jaccard threshold as a fraction num / den, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n + (-self.num * n) // self.den + 1

    def met(self, shared: int, n: int, m: int) -> bool:
        return self.den * shared >= self.num * (n + m - shared)

    def may_share(self, most: Column, n: Column, m: Column) -> Column:
        """most >= num / (num + den) * (n + m): enough for the threshold."""
        return (self.num + self.den) * most >= self.num * (n + m)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _marks(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each whole set, as two whole numbers."""
    import xxhash

    return np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, s1, s2 (of the whole set); empty sets have n = 0.

    Beside them, in rows of n = -1, the shingles that different sets of a stretch of a task's documents share, with the
    number of these sets. A stretch holds STRETCH shingles at most.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n", "s1", "s2", "shingles", "counts"]

    def shared(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        more = counts > 1
        one = lambda kind: pa.nulls(1, kind)
        row = [one(pa.int64()), pa.array([-1], pa.int64()), one(pa.int64()), one(pa.int64()), _lists([values[more]]), _lists([counts[more].astype(np.int64)])]
        return pa.RecordBatch.from_arrays(row, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(forget=True)
        held: list[np.ndarray] = []
        size, seen = 0, set()
        for batch in batches:
            sets = [shingles(x, k) for x in batch.column(1).to_pylist()]
            marks = _marks(sets)
            no = pa.nulls(len(sets), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), no, no], names)
            for s, m in zip(sets, map(tuple, marks.tolist()), strict=True):
                if len(s) and m not in seen:
                    seen.add(m)
                    held.append(s)
                    size += len(s)
            if size > STRETCH:
                yield shared(held)
                held, size, seen = [], 0, set()
        if held:
            yield shared(held)
        del held
        release()

    return docs.mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, shingles array<bigint>, counts array<bigint>")


def _prefixes(docs: DataFrame, k: int, t: Threshold, common) -> DataFrame:
    """node (doc_id), n, s1, s2, prefix in the global order, sketch, of every set that is not empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = common.value
        for batch in batches:
            sets = [shingles(x, k) for x in batch.column(1).to_pylist()]
            marks = _marks(sets)
            prefix = _lists([_rarest(s, t.prefix(len(s)), hashes, ranks) for s in sets])
            sketch = pa.array([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=SKETCH).astype("<i4").tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), prefix, sketch], ["node", "n", "s1", "s2", "prefix", "sketch"])
        release()

    return docs.mapInArrow(run, "node bigint, n bigint, s1 bigint, s2 bigint, prefix array<bigint>, sketch binary").where("n > 0")


def _rarest(s: np.ndarray, p: int, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first p of a set in the global order: shingles outside of the table by hash, then the table's by rank."""
    if not len(s) or not len(hashes):
        return s[:p]
    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
    known = hashes[at] == s
    rare = s[~known]
    if len(rare) >= p:
        return rare[:p]
    return np.concatenate([rare, s[known][np.argsort(ranks[at[known]], kind="stable")]])[:p]


# ---- pairs ------------------------------------------------------------------------------------------------------
def _bounded(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The stored pairs (a, b) whose sketches leave room for the threshold.

    sets: node, sketch, lo, far. A set may stand for a group: lo is the least size in it, far the most shingles that one
    of the group has and the set has not.
    """
    side = lambda x: sets.select(F.col("node").alias(x), F.col("lo").alias(f"n_{x}"), F.col("far").alias(f"far_{x}"), F.col("sketch").alias(f"k_{x}"))
    rows = side("a").join(sized(pairs), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(f"k_{s}").to_pylist()), "<i4").reshape(-1, SKETCH) for s in "ab")
            most = np.minimum(x, y).sum(1) + batch.column("far_a").to_numpy() + batch.column("far_b").to_numpy()
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = pa.array((t.num + t.den) * most >= t.num * n)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _overlaps(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """a, b, shared, n_a, n_b, stored: how many shingles the whole sets of each pair (a, b) of doc_ids share, and have."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = docs.join(sized(ids), "doc_id", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x, k).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "items"])

    sets = stored(texts.mapInArrow(make, "doc_id bigint, items binary"), "sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("items").alias(f"items_{x}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                rows.append((len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v)))
            counts = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *counts], ["a", "b", "shared", "n_a", "n_b"])
        release()

    return stored(side("a").join(sized(pairs), "a").join(side("b"), "b").mapInArrow(compare, "a bigint, b bigint, shared bigint, n_a bigint, n_b bigint"), "overlaps")


def _models(links: DataFrame) -> DataFrame:
    """node, model, d: the least set that a set is linked to, where that one has no model itself; d: what the set has beyond it.

    links: a < b with shared, n_a and n_b.
    """
    least = stored(links.groupBy(F.col("b").alias("node")).agg(F.min_by(F.struct(F.col("a").alias("model"), (F.col("n_b") - F.col("shared")).alias("d")), "a").alias("m")).select("node", "m.*"), "least")
    return stored(least.join(least.select(F.col("node").alias("model")), "model", "left_anti").select("node", "model", "d"), "models")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _fits(t: Threshold, n: str, pos: str, m: str, at: str) -> Column:
    """Sizes and positions of a shared shingle leave room for the threshold, if it is the first that they share."""
    n, pos, m, at = map(F.col, (n, pos, m, at))
    most = 1 + F.least(n - pos, m - at) - 1
    return (t.den * F.least(n, m) >= t.num * F.greatest(n, m)) & t.may_share(most, n, m)


def _leader_pairs(index: DataFrame, t: Threshold, turn: int) -> DataFrame:
    """Pairs of each list's leader with the entries of other components."""
    order = F.col("node") if turn == 0 else F.xxhash64("shingle", "node", F.lit(turn))
    first = F.min(F.struct(order.alias("key"), "node", "n", "pos", "comp")).alias("first")
    lists = index.groupBy("shingle").agg(first, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    lists = lists.select("shingle", *[F.col(f"first.{c}").alias(f"l_{c}") for c in ("node", "n", "pos", "comp")])
    met = index.join(lists, "shingle").where((F.col("comp") != F.col("l_comp")) & _fits(t, "n", "pos", "l_n", "l_pos"))
    return met.select(*_ordered(F.col("node"), F.col("l_node"))).distinct()


def _cross_pairs(index: DataFrame, t: Threshold) -> DataFrame:
    """All candidate pairs of groups of different components, block against block.

    index: shingle, node, n, pos, comp, model. A list has one entry for all of a model's sets in it.
    """
    lists = index.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    groups = index.join(lists, "shingle", "left_semi").groupBy("shingle", F.col("model").alias("node"), "comp")
    rows = groups.agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    size_class = F.floor(F.log(F.col("n_lo").cast("double")) / F.log(F.lit(t.den / t.num))).cast("int")
    pos = F.greatest(F.lit(0), F.col("n_lo") - F.col("rest"))
    place = F.floor(8 * pos * t.den / (F.col("n_lo") * (t.den - t.num) + t.den)).cast("int")
    rows = stored(rows.withColumn("size_class", size_class).withColumn("place", place), "lists")
    key = ["shingle", "size_class", "place"]
    parts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ENTRIES).cast("int").alias("parts"))
    rows = rows.join(parts, key).withColumn("block", F.struct("size_class", "place", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
    rows = stored(rows.select("shingle", "block", "node", "n_lo", "n_hi", "rest", "comp"), "blocks")
    blocks = rows.groupBy("shingle", "block").agg(
        F.min("n_lo").alias("n_lo"), F.max("n_hi").alias("n_hi"), F.max("rest").alias("rest"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    # A long list's blocks are dealt into parts on one side and meet each part on the other.
    share = blocks.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCKS).cast("int").alias("shares"))
    blocks = stored(blocks.join(share, "shingle"), "block-list")
    one, two = (blocks.select("shingle", "shares", *[F.col(c).alias(f"{c}_{s}") for c in blocks.columns if c not in ("shingle", "shares")]) for s in "ab")
    one = one.withColumn("share", F.pmod(F.xxhash64("block_a"), F.col("shares")).cast("int")).drop("shares")
    two = two.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    # What holds for blocks, groups and sets alike: some sizes are near enough, and enough is left behind the shingle.
    near = (t.den * F.col("n_hi_a") >= t.num * F.col("n_lo_b")) & (t.den * F.col("n_hi_b") >= t.num * F.col("n_lo_a"))
    room = t.may_share(F.least("rest_a", "rest_b"), F.col("n_lo_a"), F.col("n_lo_b"))
    other = ~((F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b")))
    met = one.join(two, ["shingle", "share"]).where((F.col("block_a") <= F.col("block_b")) & near & room & other).select("shingle", "block_a", "block_b")
    left, right = (rows.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "shingle"]) for s in "ab")
    met = stored(met, "met")
    pairs = left.join(sized(met, BROADCAST_BLOCKS), ["shingle", "block_a"]).join(right, ["shingle", "block_b"])
    return pairs.where((F.col("comp_a") != F.col("comp_b")) & near & room).select(*_ordered(F.col("node_a"), F.col("node_b"))).distinct()


def _derived(pairs: DataFrame, overlaps: DataFrame, groups: DataFrame, t: Threshold) -> DataFrame:
    """The candidate pairs (a, b) of sets that their models' overlap leaves room for.

    overlaps: a, b, shared of the models that are still to be told; groups: node, n, model, d. What two sets share is at
    most what their models share and what each has beyond its model; pairs of models that are not in overlaps are decided.
    """
    side = lambda s: groups.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("model").alias(f"model_{s}"), F.col("d").alias(f"d_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("*", F.least("model_a", "model_b").alias("x"), F.greatest("model_a", "model_b").alias("y"))
    rows = rows.join(sized(overlaps.select(F.col("a").alias("x"), F.col("b").alias("y"), "shared")), ["x", "y"])
    return rows.where(t.may_share(F.col("shared") + F.col("d_a") + F.col("d_b"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def jaccard_components(docs: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row, where sets of Jaccard >= num / den are linked.

    component_id: the smallest doc_id that links reach. Null or empty text, or only white space: no shingles, no links,
    its own doc_id. Null doc_id: takes no part in components other than through equal sets (null if it is alone).
    Rows that repeat a doc_id are one document: links of any of its texts count for it. Empty table: no rows.
    """
    t, rows = Threshold(num, den), text_of(docs, doc_id, text)
    spark: SparkSession = docs.sparkSession
    profiles = stored(_profiles(rows, k), "profiles")
    first = profiles.where("n >= 0")
    classes = stored(first.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "classes")
    members = classes.where("node is not null")
    # The shingles that would make the longest lists go to the end of the order.
    counts = profiles.where("n = -1").select(F.explode(F.arrays_zip("shingles", "counts")).alias("x")).groupBy(F.col("x.shingles").alias("shingle")).agg(F.sum("x.counts").alias("c"))
    top = counts.where(F.col("c") >= COMMON_FROM).orderBy(F.desc("c"), "shingle").limit(COMMON_SHINGLES).toPandas()
    hashes = top["shingle"].to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    common = spark.sparkContext.broadcast((hashes[by_hash], (len(hashes) - 1 - by_hash).astype(np.int64)))
    sets = stored(_prefixes(rows, k, t, common).join(members, ["node", "s1", "s2"]).dropDuplicates(["node", "s1", "s2"]).select("node", "n", "prefix", "sketch"), "sets")
    entries = sets.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    lists = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("shingle")
    index = stored(entries.join(lists, "shingle", "left_semi"), "index")
    size = index.count()
    sketches = sets.select("node", "sketch", F.col("n").alias("lo"), F.lit(0).cast("bigint").alias("far"))
    met = t.den * F.col("shared") >= t.num * (F.col("n_a") + F.col("n_b") - F.col("shared"))

    roots: DataFrame | None = None
    found: list[DataFrame] = []  # the links of each round

    def placed() -> DataFrame:
        if roots is None:
            return index.withColumn("comp", F.col("node"))
        return index.join(sized(roots), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")

    def compared(pairs: DataFrame, by: DataFrame) -> DataFrame:
        return _overlaps(stored(_bounded(stored(pairs, "pairs"), by, t), "bounded"), rows, k)

    def joined(links: DataFrame) -> DataFrame:
        links = links.select("a", "b")
        return links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))

    before = float("inf")
    for turn in range(MAX_ROUNDS):
        at = placed()
        if turn:
            by = at.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg((F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))).alias("x"))
            crossing = by.agg(F.sum("x") / 2).first()[0] or 0
            if crossing <= 20 * size + 1_000_000 or crossing > before / 2:
                break  # few are left, or other leaders do not help
            before = crossing
        found.append(compared(_leader_pairs(at, t, turn), sketches).where(met))
        roots = components(joined(found[-1]))
    # Sets that are similar to one model are compared with others through it.
    models = _models(reduce(DataFrame.unionByName, found))
    groups = stored(sets.select("node", "n").join(sized(models), "node", "left").select("node", "n", F.coalesce("model", "node").alias("model"), F.coalesce("d", F.lit(0)).cast("bigint").alias("d")), "groups")
    some = groups.groupBy(F.col("model").alias("node")).agg(F.min("n").alias("lo"), F.max("d").alias("far"), F.count(F.lit(1)).alias("size"))
    some = stored(some.join(sets.select("node", "sketch"), "node"), "models")
    last = placed().join(sized(models.select("node", "model")), "node", "left").withColumn("model", F.coalesce("model", "node"))
    over = compared(_cross_pairs(last, t), some)
    roots = components(joined(over.where(met)))
    rest = over.where(~met).select("a", "b", "shared")
    for x in "ab":  # pairs of models that are in one component by now need no more
        rest = rest.join(sized(roots.select(F.col("node").alias(x), F.col("root").alias(f"comp_{x}"))), x, "left").withColumn(f"comp_{x}", F.coalesce(f"comp_{x}", x))
        rest = rest.join(sized(some.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"))), x)
    rest = stored(rest.where("comp_a <> comp_b and (size_a > 1 or size_b > 1)").select("a", "b", "shared"), "open")
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not rest.isEmpty():
        own = stored(_cross_pairs(placed().withColumn("model", F.col("node")), t), "own")
        links = joined(compared(_derived(own, rest, groups, t), sketches).where(met))
    # A document with several sets ties their classes, whose nodes may be other documents.
    several = first.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("s1", "s2") for f in (F.min, F.max)])
    several = stored(several.where("s1_min <> s1_max or s2_min <> s2_max").select("doc_id"), "several")
    if not several.isEmpty():
        ties = first.where("n > 0").join(sized(several), "doc_id", "left_semi").join(classes, ["s1", "s2"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
        links = links.unionByName(ties)
    roots = components(links)
    decided = classes.join(sized(roots), "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("own"))
    some = first.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").where("n > 0")
    out = spread_join(some, decided, ["s1", "s2"], ["doc_id"]).select("doc_id", "n_shingles", F.coalesce("own", "doc_id").alias("component_id"))
    return out.unionByName(first.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op3_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


QUERIES = {"op3_set_relation_join": op3_set_relation_join}
#: For small tables: every pair of documents that share a shingle is counted there, and every reachable pair listed.
ORACLES = {
    "op3_set_relation_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
}
