"""Bounded stores: maps of a tab or a session that hold so many keys, fed by puts in order of seq.

Puts: store_id, seq, key, value, generation. A null key closes the store, which drops all that it holds. A put of an older
generation than the store has seen is the result of a pass that was superseded: it changes nothing; a null generation is of
no pass and always counts. Rows of equal seq are taken in the order of key (null first), value and generation. A null store_id
is a store, too. No puts: no rows. Both give store_id, place (from 1, the next to go first), key, value.
`lumenweft.streaming.bounded` keeps the same stores as streams, with expiry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys that one tab's store of sniffed media holds, and that the store of products holds.
SNIFFED_CAP = 800
PRODUCTS_CAP = 200
HELD = "store_id string, place bigint, key string, value string"
_ORDER = ("seq", "key", "value", "generation")


def current(puts: DataFrame) -> DataFrame:
    """puts without those that were superseded before they came."""
    seen = W.partitionBy("store_id").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    newest = puts.withColumn("_newest", F.max("generation").over(seen))
    return newest.where("key is null or generation is null or generation >= _newest").drop("_newest")


def most_recent(puts: DataFrame, cap: int = PRODUCTS_CAP) -> DataFrame:
    """What the stores hold where a put makes its key the newest and the key that was put longest ago goes."""
    puts = current(puts)
    closed = puts.where("key is null").groupBy("store_id").agg(F.max("seq").alias("_closed"))
    last = puts.where("key is not null").groupBy("store_id", "key").agg(F.max(F.struct("seq", "value")).alias("b"))
    # a close comes before the puts of its seq
    kept = last.join(closed.withColumnRenamed("store_id", "_s"), F.col("store_id").eqNullSafe(F.col("_s")), "left").where("_closed is null or b.seq >= _closed")
    newest = kept.withColumn("_n", F.row_number().over(W.partitionBy("store_id").orderBy(F.col("b.seq").desc(), F.col("key").desc()))).where(F.col("_n") <= cap)
    place = F.row_number().over(W.partitionBy("store_id").orderBy(F.col("_n").desc()))
    return newest.select("store_id", place.cast("bigint").alias("place"), "key", F.col("b.value").alias("value"))


def first_in(puts: DataFrame, cap: int = SNIFFED_CAP) -> DataFrame:
    """What the stores hold where a put leaves a held key in its place, and a new key drives out the one that came first.

    Whether a put is of a new key depends on all before it, so a store's puts are folded in order; they stream through the
    task, which holds one store's keys at a time.
    """
    rows = current(puts).select("store_id", *[F.col(c) for c in _ORDER[:3]])
    rows = rows.repartition("store_id").sortWithinPartitions("store_id", *_ORDER[:3]).select("store_id", "key", "value")

    def pack(store: str | None, held: dict[str, str]) -> pa.RecordBatch:
        columns = ([store] * len(held), range(1, len(held) + 1), list(held), list(held.values()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["store_id", "place", "key", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held = None, {}
        for batch in batches:
            for s, key, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if s != store:
                    if held:
                        yield pack(store, held)
                    store, held = s, {}
                if key is None:
                    held = {}
                    continue
                if key not in held and len(held) >= cap:
                    del held[next(iter(held))]
                held[key] = value
        if held:
            yield pack(store, held)

    return rows.mapInArrow(run, HELD)
