"""The folds of queue and deep scan as stateful streams: the same code, with the state kept between batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lumenweft.operators import deepscan, queue

STATE = "state binary"


def queue_stream(events: DataFrame, concurrency: int = 5) -> DataFrame:
    """A stream of queue events -> the items of every queue that changed in a batch (update mode)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        q = pickle.loads(state.get[0]) if state.exists else queue.Queue(concurrency=concurrency)
        rows = pd.concat(list(frames))
        queue.fold_rows(q, rows)
        state.update((pickle.dumps(q),))
        yield queue.frame(key[0], q)

    return events.groupBy("queue_id").applyInPandasWithState(run, f"queue_id string, place int, {queue.ITEM}", STATE, "update", "NoTimeout")


def scan_stream(rounds: DataFrame, **limits) -> DataFrame:
    """A stream of scan rounds -> each scan's state after a batch. A round must arrive whole."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = pickle.loads(state.get[0]) if state.exists else deepscan.Scan(**limits)
        deepscan.fold_rounds(s, pd.concat(list(frames)))
        state.update((pickle.dumps(s),))
        yield pd.DataFrame([s.row(key[0])])

    return rounds.groupBy("scan_id").applyInPandasWithState(run, deepscan.RESULT, STATE, "update", "NoTimeout")
