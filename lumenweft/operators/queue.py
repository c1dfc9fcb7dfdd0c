"""The download queue as a fold of its events, in batch and in a stream.

Events of a queue, in order of seq: (seq, now_ms, event, id, url, filename, download_id, error). The state is a small
list of items; live items are never dropped, finished ones are pruned to the newest FINISHED_CAP and, of these, to those within FINISHED_BYTES.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
FINISHED_CAP = 200
FINISHED_BYTES = 1_000_000
RECOVER_GRACE_MS = 10_000
ITEM = "id string, url string, filename string, status string, attempts int, error string, download_id bigint, claimed_at bigint, ready_at bigint, added_at bigint, use_referer boolean, bytes_received bigint, total_bytes bigint"
FIELDS = [c.split()[0] for c in ITEM.split(", ")]
#: Events that name an item by its id.
BY_ID = ("active", "complete", "interrupted", "retry", "retry_referer")
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def backoff_ms(attempts: int, cap: int = 30_000) -> int:
    return min(1000 * 2 ** (attempts - 1), cap)


class Queue:
    """One queue's state."""

    def __init__(self, items: list[dict] | None = None, paused: bool = False, concurrency: int = 5) -> None:
        self.items, self.paused, self.concurrency = items or [], paused, max(1, int(concurrency))

    @staticmethod
    def live(i: dict) -> bool:
        return i["status"] in ("queued", "active")

    def _one(self, key: str, value) -> dict | None:
        if value is not None:
            for i in self.items:
                if i[key] == value:
                    return i
        return None

    @staticmethod
    def _at_most(items: list[dict]) -> int:
        """Bytes that the items have at most as JSON: no character is longer than six there."""
        return sum(440 + 6 * (len(i["id"] or "") + len(i["url"] or "") + len(i["filename"] or "") + len(i["error"] or "")) for i in items)

    def _prune(self) -> None:
        # sizes are only taken where the bytes may be too many
        if len(self.items) <= FINISHED_CAP and self._at_most(self.items) <= FINISHED_BYTES:
            return
        done = sorted((i for i in self.items if not self.live(i)), key=lambda i: -i["added_at"])[:FINISHED_CAP]
        if self._at_most(done) > FINISHED_BYTES:
            sizes = accumulate(len(json.dumps({k: v for k, v in i.items() if v is not None}, ensure_ascii=False, separators=(",", ":")).encode()) for i in done)
            done = [i for i, size in zip(done, sizes, strict=True) if size <= FINISHED_BYTES]
        kept = {id(i) for i in done}
        self.items = [i for i in self.items if self.live(i) or id(i) in kept]

    def enqueue(self, now: int, id: str, url: str, filename: str) -> None:
        if any(self.live(i) and i["url"] == url and i["filename"] == filename for i in self.items):
            return
        self.items.append(dict.fromkeys(FIELDS) | {"id": id, "url": url, "filename": filename, "status": "queued", "attempts": 0, "ready_at": now, "added_at": now})
        self._prune()

    def claim(self, now: int) -> dict | None:
        """The first item that is ready becomes active, if the queue is not paused and a slot is free."""
        if self.paused or sum(i["status"] == "active" for i in self.items) >= self.concurrency:
            return None
        found = next((i for i in self.items if i["status"] == "queued" and i["ready_at"] <= now), None)
        if found is not None:
            found.update(status="active", claimed_at=now)
        return found

    def retry(self, i: dict, now: int) -> None:
        i["attempts"] += 1
        i["download_id"] = None
        if i["attempts"] >= MAX_ATTEMPTS:
            i.update(status="failed", error=i["error"] or "retry limit reached")
        else:
            i.update(status="queued", ready_at=now + backoff_ms(i["attempts"]), bytes_received=None, total_bytes=None)

    def renew(self, i: dict, now: int, referer: bool = False) -> None:
        if i["status"] == "failed":
            i.update(status="queued", attempts=0, error=None, ready_at=now, download_id=None, use_referer=referer or None, bytes_received=None, total_bytes=None)

    def apply(self, event: str, now: int, id: str | None = None, url: str | None = None, filename: str | None = None, download_id: int | None = None, error: str | None = None) -> None:
        """One event. What names no item changes nothing."""
        item = self._one("id", id) if event in BY_ID else None
        match event:
            case "enqueue":
                self.enqueue(now, id or "", url or "", filename or "")
            case "claim":
                self.claim(now)
            case "active" if item:
                item.update(status="active", download_id=download_id, claimed_at=None)
            case "complete":
                if item := item or self._one("download_id", download_id):
                    item["status"] = "done"
            case "interrupted":
                if item := item or self._one("download_id", download_id):
                    if error == "SERVER_FORBIDDEN" and not item["use_referer"]:
                        self.retry(item, now)
                        item["use_referer"] = True
                    elif error in ("SERVER_FORBIDDEN", "USER_CANCELED"):
                        item.update(status="failed", error=error)
                    else:
                        self.retry(item, now)
            case "retry" if item:
                self.renew(item, now)
            case "retry_referer" if item:
                self.renew(item, now, True)
            case "retry_all":
                for i in self.items:
                    self.renew(i, now)
            case "recover":
                for i in self.items:
                    if i["status"] == "active" and i["download_id"] is None and now - (i["claimed_at"] or 0) > RECOVER_GRACE_MS:
                        i.update(status="queued", ready_at=now, claimed_at=None)
            case "cancel":
                self.items = [i for i in self.items if i["id"] != id]
            case "cancel_all":
                self.items = [i for i in self.items if not self.live(i)]
            case "clear_finished":
                self.items = [i for i in self.items if self.live(i)]
            case "pause":
                self.paused = True
            case "resume":
                self.paused = False
            case "progress":
                if (i := self._one("download_id", download_id)) and i["status"] == "active":
                    i["bytes_received"] = int(error or 0)


def _plain(v):
    return None if v is None or v != v else v


def fold_rows(queue: Queue, rows: pd.DataFrame) -> Queue:
    for r in rows.sort_values("seq", kind="stable").itertuples(index=False):
        did = _plain(r.download_id)
        queue.apply(r.event, int(r.now_ms), _plain(r.id), _plain(r.url), _plain(r.filename), None if did is None else int(did), _plain(r.error))
    return queue


def frame(queue_id: str, queue: Queue) -> pd.DataFrame:
    out = pd.DataFrame([{"queue_id": queue_id, "place": k} | i for k, i in enumerate(queue.items)], columns=["queue_id", "place", *FIELDS])
    for c in ("download_id", "claimed_at", "ready_at", "added_at", "bytes_received", "total_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def _values(c: pa.Array) -> list:
    """A column as Python values, null as None; several times faster than to_pylist()."""
    return (c.to_pandas(integer_object_nulls=True) if pa.types.is_integer(c.type) else c.to_numpy(zero_copy_only=False)).tolist()


def fold(events: DataFrame, concurrency: int = 5, fields: Iterable[str] = FIELDS) -> DataFrame:
    """Each queue's items after all of its events, with those of their fields. A queue is one user's session; its events stream through one task in order, and only the queue's items are held."""
    kinds = dict(f.split() for f in ITEM.split(", "))
    wanted = list(fields)
    result = ", ".join(["queue_id string", "place int", *[f"{c} {kinds[c]}" for c in wanted]])
    schema = pa.schema([(c, ARROW[kind]) for c, kind in (f.split() for f in result.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(schema)
            made = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)
            out.clear()
            return made

        current, queue = None, None

        def finish() -> None:
            if queue is not None:
                out.extend((current, k, *[i[f] for f in wanted]) for k, i in enumerate(queue.items))

        for b in batches:
            for queue_id, now, event, *rest in zip(*map(_values, b.columns), strict=True):
                if queue is None or queue_id != current:
                    finish()
                    current, queue = queue_id, Queue(concurrency=concurrency)
                queue.apply(event, int(now), *rest)
            yield batch()
        finish()
        yield batch()

    rows = events.select("queue_id", "now_ms", "event", "id", "url", "filename", F.col("download_id").cast("bigint"), "error", "seq")
    rows = rows.repartition("queue_id").sortWithinPartitions("queue_id", F.asc_nulls_last("seq")).drop("seq")
    return rows.mapInArrow(run, result)


def counters(items: DataFrame) -> DataFrame:
    n = lambda s: F.sum((F.col("status") == s).cast("bigint")).alias(s)
    return items.groupBy("queue_id").agg(n("queued"), n("active"), n("done"), n("failed"))


def adopt(stuck: DataFrame, downloads: DataFrame) -> DataFrame:
    """stuck (id, url, …) with download_id and state of the first download (url, download_id, state, start_ms) of its address that runs or is complete; ties by the smaller download_id."""
    fine = downloads.where("state in ('complete', 'in_progress')")
    first = fine.groupBy("url").agg(F.min_by(F.struct("download_id", "state"), F.struct("start_ms", "download_id")).alias("_hit"))
    return stuck.join(first, "url", "left").select(*stuck.columns, "_hit.*")


def reconciled(items: DataFrame, downloads: DataFrame, now_ms: int) -> DataFrame:
    """items (queue_id, place, and ITEM) as they are after a restart, given the downloads (url, download_id, state, start_ms) that there are; and finished, whether the item was found complete.

    An active item without a download that was claimed longer than the grace ago takes the first download of its address that
    runs or is complete; where there is none it is queued again. One whose download is complete is done; one whose
    download is interrupted or gone is retried, and fails with its last attempt. Of several downloads of one id the
    one that began last counts. All other items stay as they are; a null status is none of these.
    """
    active, own = F.col("status") == "active", F.col("download_id").isNotNull()
    stuck = active & ~own & (F.lit(now_ms) - F.coalesce("claimed_at", F.lit(0)) > RECOVER_GRACE_MS)
    rows = items.withColumn("_stuck", F.coalesce(stuck, F.lit(False)))
    addresses = downloads.select("url", "download_id", "state", "start_ms")
    by_url = adopt(rows.where("_stuck").select("url").distinct(), addresses).withColumnsRenamed({"download_id": "_taken", "state": "_taken_state"})
    by_id = addresses.groupBy("download_id").agg(F.max_by("state", F.struct("start_ms", "state")).alias("_state"))
    # rows that a join has nothing for are dealt by a hash, whatever it finds for them is not looked at
    dealt = F.xxhash64("queue_id", "id")
    by_url, by_id = by_url.withColumnRenamed("url", "_url"), by_id.withColumnRenamed("download_id", "_own")
    rows = rows.withColumns({"_u": F.when(F.col("_stuck"), F.col("url")).otherwise(dealt.cast("string")), "_d": F.coalesce("download_id", dealt)})
    rows = rows.join(by_url, F.col("_u") == F.col("_url"), "left").join(by_id, F.col("_d") == F.col("_own"), "left")
    taken = F.when(F.col("_stuck"), F.col("_taken_state"))
    orphan = F.col("_stuck") & F.col("_taken").isNull()
    known = F.coalesce(active & own, F.lit(False))
    finished = F.coalesce(taken == "complete", F.lit(False)) | (known & F.coalesce(F.col("_state") == "complete", F.lit(False)))
    lost = known & ~F.coalesce(F.col("_state").isin("complete", "in_progress"), F.lit(False))
    attempts = F.col("attempts") + lost.cast("int")
    failed = lost & (attempts >= MAX_ATTEMPTS)
    again = lost & ~failed
    backoff = F.least(F.lit(1000) * F.pow(F.lit(2.0), attempts - 1), F.lit(30_000.0)).cast("bigint")
    values = {
        "status": F.when(finished, "done").when(failed, "failed").when(orphan | again, "queued").otherwise(F.col("status")), "attempts": attempts, "error": F.when(failed, F.coalesce("error", F.lit("retry limit reached"))).otherwise(F.col("error")),
        "download_id": F.when(lost, None).when(taken == "in_progress", F.col("_taken")).otherwise(F.col("download_id")), "claimed_at": F.when(orphan | (taken == "in_progress"), None).otherwise(F.col("claimed_at")),
        "ready_at": F.when(orphan, F.lit(now_ms)).when(again, F.lit(now_ms) + backoff).otherwise(F.col("ready_at")), "bytes_received": F.when(again, None).otherwise(F.col("bytes_received")), "total_bytes": F.when(again, None).otherwise(F.col("total_bytes")),
    }
    kinds = dict(items.dtypes)
    return rows.select(*[(values[c].cast(kinds[c]) if c in values else F.col(c)).alias(c) for c in items.columns], finished.alias("finished"))
