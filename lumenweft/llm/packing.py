"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of equal length are interchangeable, so what is to be solved is the histogram of lengths: as many counts as a
sequence has tokens, whatever the number of documents. Large histograms are divided: counts // s of each length is
solved once and the solution used s times, and what the division leaves is a histogram of its own, divided in turn.
Each problem has PROBLEM_PIECES pieces at most, and every division leaves less than the capacity times s of them, so
the levels grow with the logarithm of the input.

A chromosome is a list of bins (groups of lengths). A crossover injects whole, well-filled bins of one parent into the
other, removes the receiver's bins whose pieces would be there twice, and packs the displaced pieces again, the longest
first, each where the least room is left. Every island evolves a population of its own in a Spark task; between epochs
each island's best packing migrates to the next one. The driver holds packings of histograms, never documents.

Pieces get their places by rank: the n-th piece of a length takes the n-th slot of that length. Ranks come from counts
by partition and length, so no task gathers the pieces of a common length.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.llm._common import release, small_batches, stored, table, text_of
from lumenweft.llm._tokenizers import encoder

CAPACITY = 2048
PROBLEM_PIECES = 32_768
ISLANDS = 6
POPULATION = 4
GENERATIONS = 4
EPOCHS = 2
#: Words that a worker remembers (twice as many at most): speed against memory.
MEMO_ENTRIES = 600_000

Bins = list[tuple[int, ...]]


# ---- one island -------------------------------------------------------------------------------------------------
def best_fit(lengths: list[int], bins: Bins, capacity: int) -> Bins:
    """Puts each length, in the order given, into the bin with the least room for it, or into a new one."""
    out = [list(b) for b in bins]
    room: dict[int, list[int]] = defaultdict(list)
    mask = 0  # bit g: some bin has room for g
    for i, b in enumerate(out):
        if gap := capacity - sum(b):
            room[gap].append(i)
            mask |= 1 << gap
    for n in lengths:
        above = mask >> n
        if above:
            gap = n + (above & -above).bit_length() - 1
            where = room[gap]
            i = where.pop()
            if not where:
                mask ^= 1 << gap
        else:
            gap, i = capacity, len(out)
            out.append([])
        out[i].append(n)
        if gap > n:
            room[gap - n].append(i)
            mask |= 1 << (gap - n)
    return [tuple(sorted(b, reverse=True)) for b in out]


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among as many, the more uneven their fill the better, as empty room then lies together."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def crossover(receiver: Bins, donor: Bins, counts: Counter, capacity: int, rng: random.Random) -> Bins:
    """Injects a part of the donor's best-filled bins; the receiver's bins that still can be made stay."""
    share = rng.uniform(0.2, 0.6)
    filled = sorted(donor, key=lambda b: (-sum(b), rng.random()))[: max(1, len(donor) // 2)]
    left = counts.copy()
    child: Bins = []
    for b in filled:
        if rng.random() < share:
            child.append(b)
            for n in b:
                left[n] -= 1
    for b in sorted(receiver, key=lambda b: -sum(b)):
        if sum(b) < 0.98 * capacity and rng.random() < 0.5:
            continue  # ill-filled bins are broken up now and then
        for k, n in enumerate(b):
            left[n] -= 1
            if left[n] < 0:
                for m in b[: k + 1]:
                    left[m] += 1
                break
        else:
            child.append(b)
    displaced = sorted((n for n, c in left.items() for _ in range(c)), reverse=True)
    return best_fit(displaced, child, capacity)


def evolve(counts: Counter, population: list[Bins], capacity: int, generations: int, size: int, seed: int) -> list[Bins]:
    """The population, best first, after so many generations."""
    rng = random.Random(seed)
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    items = sorted(counts.elements(), reverse=True)
    population = list(population)
    while len(population) < size:
        noise = 0.0 if not population else 0.05 * capacity * len(population)
        order = sorted(items, key=lambda n: -(n + rng.uniform(0, noise))) if noise else items
        population.append(best_fit(order, [], capacity))
    population.sort(key=lambda b: fitness(b, capacity), reverse=True)
    for _ in range(generations):
        if len(population[0]) <= bound:
            break
        children = [crossover(*rng.sample(population, 2), counts, capacity, rng) for _ in range(size // 2)]
        population = sorted(population + children, key=lambda b: fitness(b, capacity), reverse=True)[:size]
    return population


def _flat(bins: Bins) -> bytes:
    import pickle

    return pickle.dumps((np.array([len(b) for b in bins], np.int32), np.array([n for b in bins for n in b], np.int32)))


def _bins(data: bytes) -> Bins:
    import pickle

    sizes, flat = pickle.loads(data)
    ends = np.cumsum(sizes)
    values = flat.tolist()
    return [tuple(values[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def solve(spark: SparkSession, counts: Counter, capacity: int, islands: int = ISLANDS, population: int = POPULATION, generations: int = GENERATIONS, epochs: int = EPOCHS, seed: int = 1) -> Bins:
    """The best packing of one problem that the islands find. At most PROBLEM_PIECES pieces are asked for."""
    counts = Counter({n: c for n, c in counts.items() if c})
    total = sum(n * c for n, c in counts.items())
    if not total:
        return []
    bound = -(-total // capacity)
    own: dict[int, list[bytes]] = {i: [] for i in range(islands)}
    best: Bins = []
    for epoch in range(epochs):
        sent = spark.createDataFrame([(i, own[i]) for i in range(islands)], "island int, packings array<binary>").repartition(islands, "island")

        def run(batches: Iterator[pd.DataFrame], epoch=epoch) -> Iterator[pd.DataFrame]:
            release(forget=True)  # the pieces are stored: no worker needs its encoder
            for batch in batches:
                rows = []
                for i, packings in zip(batch["island"], batch["packings"], strict=True):
                    found = evolve(counts, [_bins(p) for p in packings], capacity, generations, population, hash((seed, epoch, int(i))))
                    rows.append((i, [_flat(b) for b in found]))
                yield pd.DataFrame(rows, columns=["island", "packings"])

        found = {r["island"]: [bytes(p) for p in r["packings"]] for r in sent.mapInPandas(run, "island int, packings array<binary>").collect()}
        elites = {i: _bins(found[i][0]) for i in found}
        best = max([*elites.values(), *([best] if best else [])], key=lambda b: fitness(b, capacity))
        if len(best) <= bound:
            break
        own = {i: [*found[i][:-1], found[(i - 1) % islands][0]] for i in range(islands)}  # the elite of the neighbour comes in for the worst
    return best


def pack_histogram(spark: SparkSession, counts: Counter, capacity: int = CAPACITY, problem: int = PROBLEM_PIECES, **how) -> list[tuple[tuple[int, ...], int]]:
    """(bin, how many times) for all pieces of the histogram; pieces as long as a sequence fill one each."""
    out: list[tuple[tuple[int, ...], int]] = []
    left = Counter({n: c for n, c in counts.items() if c and n < capacity})
    if counts.get(capacity):
        out.append(((capacity,), counts[capacity]))
    while left:
        times = max(1, -(-sum(left.values()) // problem))
        part = Counter({n: c // times for n, c in left.items() if c // times})
        out.extend((b, m * times) for b, m in Counter(solve(spark, part, capacity, **how)).items())
        left = Counter({n: c % times for n, c in left.items() if times > 1 and c % times})
    return out


# ---- documents --------------------------------------------------------------------------------------------------
def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", entries: int = MEMO_ENTRIES, special: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every whole text's ids and end_id, cut only where longer than capacity.

    special: as in WordEncoder. Also part and nth: the piece is the nth of its length in its partition; so the table is stored before it is used.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, seen = encoder(tokenizer, False, entries=entries, special=special), Counter()
        end = end_id.to_bytes(2, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                wide = np.frombuffer(ids + end, "<u2").astype("<u4").tobytes()
                n = len(wide) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((doc, piece, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        release()

    return stored(text_of(docs, doc_id, text).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"), "pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", entries: int = MEMO_ENTRIES, special: bool = False, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Null or empty text: a piece with only end_id. Null doc_id is carried. Rows that repeat a doc_id are packed each.
    Sequences are gapless from 0. Empty table: no rows.
    """
    spark = docs.sparkSession
    pieces = cut(docs, tokenizer, end_id, capacity, doc_id, text, entries, special)
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # at most `capacity` rows
    counts = Counter({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()})
    used: Counter = Counter()
    slots: list[tuple[int, int, int, int]] = []  # key of length and first rank, first sequence, offset
    sequence = 0
    for b, times in pack_histogram(spark, counts, capacity, **how):
        offset = 0
        for n in b:
            slots.append(((n << 44) + used[n], sequence, offset, used[n]))
            used[n] += times
            offset += n
        sequence += times
    if used != counts:
        raise AssertionError("the packing does not hold every piece once")
    slots.sort()
    # Bounded by the pieces of the solved problems, not by the documents.
    shared = spark.sparkContext.broadcast(tuple(np.array(c, np.int64) for c in zip(*slots, strict=True)) if slots else (np.zeros(0, np.int64),) * 4)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release(forget=True)
        keys, first_sequence, offsets, first_rank = shared.value
        for p in batches:
            rank = p["first"].to_numpy() + p["nth"].to_numpy()
            at = np.searchsorted(keys, (p["length"].to_numpy() << 44) + rank, side="right") - 1
            yield p.assign(sequence_id=first_sequence[at] + rank - first_rank[at], offset=offsets[at])[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return pieces.join(firsts, ["length", "part"]).mapInPandas(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op6_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), special=True)


QUERIES = {"op6_island_packing": op6_island_packing}
ORACLES: dict[str, str] = {}
