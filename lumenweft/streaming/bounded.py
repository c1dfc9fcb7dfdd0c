"""Bounded stores as streams: typed maps in the state store, bounded by their caps and by expiry.

The state of a store is a map from place to key (places only grow; the least one is the next to go), a map from key to its
place and value, and five numbers. A put costs a few reads and writes of single entries whatever the store holds. A store
that nothing was put into for ttl_ms of event time is closed by a timer, and its state goes. The session must keep its state in
RocksDB: spark.sql.streaming.stateStore.providerClass names its provider (PROVIDER); another one is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenweft.operators.bounded import PRODUCTS_CAP, SNIFFED_CAP

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a batch changed: the entry of a key as it is now; alive: whether the store holds it. The greatest version of a key counts.
CHANGES = "store_id string, key string, value string, place bigint, alive boolean, version bigint"
COUNTS = "head bigint, tail bigint, size bigint, generation bigint, version bigint"
TTL_MS = 30 * 60_000


class BoundedStore(StatefulProcessor):
    """cap: keys that a store holds. moves: whether a put of a held key makes it the newest (else it stays in its place)."""

    def __init__(self, cap: int, moves: bool, ttl_ms: int) -> None:
        self.cap, self.moves, self.ttl_ms = cap, moves, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "key string", "place bigint, value string")
        self.places = handle.getMapState("places", "place bigint", "key string")
        self.counts = handle.getValueState("counts", COUNTS)

    def _clear(self, changed: dict) -> None:
        for key in [k[0] for k in self.items.keys()]:
            changed[key] = (None, None, False)
        self.items.clear()
        self.places.clear()

    def _frame(self, key: tuple, changed: dict, version: int) -> pd.DataFrame:
        rows = [(key[0], k, *v, version) for k, v in changed.items()]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])
        return out.astype({"place": "Int64", "store_id": object, "key": object, "value": object})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        puts = pd.concat(list(rows)).sort_values(["seq", "key", "value", "generation"], kind="stable", na_position="first")
        head, tail, size, generation, version = self.counts.get() if self.counts.exists() else (0, 0, 0, None, 0)
        changed: dict = {}
        for name, value, of in zip(puts["key"], puts["value"], puts["generation"], strict=True):
            of = None if pd.isna(of) else int(of)
            if of is not None and generation is not None and of < generation and not pd.isna(name):
                continue
            generation = generation if of is None else max(of, generation if generation is not None else of)
            if pd.isna(name):
                self._clear(changed)
                size, head = 0, tail
                continue
            value = None if pd.isna(value) else value
            held = self.items.getValue((name,)) if self.items.containsKey((name,)) else None
            if held is None and size >= self.cap:
                while not self.places.containsKey((head,)):
                    head += 1
                oldest = self.places.getValue((head,))[0]
                self.places.removeKey((head,))
                self.items.removeKey((oldest,))
                changed[oldest] = (None, None, False)
                head, size = head + 1, size - 1
            if held is None or self.moves:
                if held is not None:
                    self.places.removeKey((held[0],))
                    size -= 1
                place = tail
                self.places.updateValue((place,), (name,))
                tail, size = tail + 1, size + 1
            else:
                place = held[0]
            self.items.updateValue((name,), (place, value))
            changed[name] = (value, place, True)
        version += 1
        self.counts.update((head, tail, size, generation, version))
        if self.ttl_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(int(puts["ts"].max().timestamp() * 1000) + self.ttl_ms)
        if changed:
            yield self._frame(key, changed, version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version = self.counts.get()[4] + 1 if self.counts.exists() else 1
        changed: dict = {}
        self._clear(changed)
        # nothing stays but the number that orders what is written of the store
        self.counts.update((0, 0, 0, None, version))
        if changed:
            yield self._frame(key, changed, version)


def _stream(puts: DataFrame, cap: int, moves: bool, ttl_ms: int) -> DataFrame:
    spark = puts.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    rows = puts.select("store_id", "seq", "key", "value", "generation", "ts")
    return rows.groupBy("store_id").transformWithStateInPandas(BoundedStore(cap, moves, ttl_ms), CHANGES, "update", "eventTime" if ttl_ms else "none")


def first_in_stream(puts: DataFrame, cap: int = SNIFFED_CAP, ttl_ms: int = TTL_MS) -> DataFrame:
    """A stream of puts (with ts, a watermarked time) -> CHANGES of stores as operators.bounded.first_in() keeps them. ttl_ms 0: none expires."""
    return _stream(puts, cap, False, ttl_ms)


def most_recent_stream(puts: DataFrame, cap: int = PRODUCTS_CAP, ttl_ms: int = TTL_MS) -> DataFrame:
    """The same of operators.bounded.most_recent()."""
    return _stream(puts, cap, True, ttl_ms)


def contents(changes: DataFrame) -> DataFrame:
    """CHANGES of all batches so far, in any order, repeated ones too -> store_id, place, key, value."""
    last = changes.groupBy("store_id", "key").agg(F.max(F.struct("version", "alive", "place", "value")).alias("b")).where("b.alive")
    return last.select("store_id", F.row_number().over(W.partitionBy("store_id").orderBy("b.place")).cast("bigint").alias("place"), "key", F.col("b.value").alias("value"))
