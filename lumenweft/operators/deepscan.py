"""The deep scan: merging rounds of media with limits and learned pacing, and what is remembered of hosts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULTS = {"max_scrolls": 40, "max_ms": 20_000, "max_items": 1000, "idle_rounds": 3}
EMA_WEIGHT, SEED_SETTLE = 0.5, 400.0
RICH, GRANT, CEILING = 5, 10, 2
HOSTS_CAP, SETTLE_MAX, SCROLLS_MAX = 200, 10_000, 500
RESULT = "scan_id string, found bigint, rounds int, reason string, settle_ema double, quiet_ms double, hard_cap_ms double, step double"


def clamp(x: float, lo: float, hi: float) -> float:
    return min(hi, max(lo, x))


def quiet_window(ema: float) -> tuple[float, float]:
    return clamp(1.5 * ema, 250, 1200), clamp(3 * ema, 1500, 4000)


def step(added: int) -> float:
    """How far to scroll after a round: further after none, less far after many."""
    return 1.75 if added == 0 else 0.6 if added >= 15 else 1.0


class Scan:
    """One scan's state: the identities found, the idle rounds, the pace and the reason to stop, if any."""

    def __init__(self, max_scrolls: int = 40, max_ms: int = 20_000, max_items: int = 1000, idle_rounds: int = 3, seed: tuple[float, float] | None = None) -> None:
        self.max_ms, self.max_items, self.idle_rounds = max_ms, max_items, idle_rounds
        self.ceiling = CEILING * max_scrolls
        self.cap = clamp(seed[1], max_scrolls, self.ceiling) if seed else max_scrolls
        self.ema = clamp(seed[0], 0, 4000) if seed else SEED_SETTLE
        self.found: dict[str, object] = {}
        self.rounds = self.idle = 0
        self.added: int | None = None
        self.reason: str | None = None
        self.start: int | None = None

    def merge(self, media: list[tuple[str, bool, object]]) -> int:
        """media: (identity, has a media key, value). New ones come in until the limit; a repeat replaces only with a key."""
        added = 0
        for key, keyed, value in media:
            if len(self.found) >= self.max_items:
                break
            if key not in self.found:
                self.found[key] = value
                added += 1
            elif keyed:
                self.found[key] = value
        return added

    def round(self, now: int, settle_ms: float, at_bottom: bool, aborted: bool, media: list[tuple[str, bool, object]]) -> None:
        """The first round is what the page shows before any scroll."""
        if self.reason:
            return
        if self.start is None:
            self.start = now
            self.merge(media)
            return
        if self.rounds >= self.cap:
            self.reason = "max-scrolls"
        elif aborted:
            self.reason = "aborted"
        elif len(self.found) >= self.max_items:
            self.reason = "max-items"
        elif now - self.start >= self.max_ms:
            self.reason = "max-time"
        if self.reason:
            return
        self.ema = (1 - EMA_WEIGHT) * self.ema + EMA_WEIGHT * settle_ms
        self.rounds += 1
        self.added = self.merge(media)
        if len(self.found) >= self.max_items:
            self.reason = "max-items"
        elif self.added == 0:
            self.idle += 1
            if self.idle >= self.idle_rounds or at_bottom:
                self.reason = "complete"
        else:
            self.idle = 0
            if self.rounds >= self.cap and self.added >= RICH and self.cap < self.ceiling:
                self.cap = min(self.cap + GRANT, self.ceiling)

    def row(self, scan_id: str) -> dict:
        quiet, hard = quiet_window(self.ema)
        return {"scan_id": scan_id, "found": len(self.found), "rounds": self.rounds, "reason": self.reason, "settle_ema": self.ema, "quiet_ms": quiet, "hard_cap_ms": hard, "step": 1.0 if self.added is None else step(self.added)}


def fold_rounds(scan: Scan, rows: pd.DataFrame) -> Scan:
    """rows: scan_id, round_no, now_ms, settle_ms, at_bottom, aborted, identity (null: the round showed nothing), keyed, seq."""
    for _, r in rows.sort_values(["round_no", "seq"], kind="stable").groupby("round_no", sort=True):
        first = r.iloc[0]
        media = [(i, bool(k), s) for i, k, s in zip(r["identity"], r["keyed"], r["seq"], strict=True) if i is not None and i == i]
        scan.round(int(first["now_ms"]), float(first["settle_ms"]), bool(first["at_bottom"]), bool(first["aborted"]), media)
    return scan


def scans(rounds: DataFrame, **limits) -> DataFrame:
    """Each scan's outcome. A scan is one page's visit and bounded by its limits."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([fold_rounds(Scan(**limits), rows).row(key[0])])

    return rounds.groupBy("scan_id").applyInPandas(run, RESULT)


def memory(samples: DataFrame, cap: int = HOSTS_CAP) -> DataFrame:
    """samples (host, time_ms, settle_ms, scrolls) -> (host, settle_ms, scrolls, updated_at): blended half and half with each visit, rounded, of the hosts seen last."""

    def blend(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        settle = scrolls = None
        at = 0
        for r in rows.sort_values("time_ms", kind="stable").itertuples(index=False):
            s, c = (clamp(x if x == x and x >= 0 else 0, 0, hi) for x, hi in ((float(r.settle_ms), SETTLE_MAX), (float(r.scrolls), SCROLLS_MAX)))
            settle = int(s + 0.5) if settle is None else int(0.5 * settle + 0.5 * s + 0.5)
            scrolls = int(c + 0.5) if scrolls is None else int(0.5 * scrolls + 0.5 * c + 0.5)
            at = int(r.time_ms)
        return pd.DataFrame({"host": [key[0]], "settle_ms": [settle], "scrolls": [scrolls], "updated_at": [at]})

    out = samples.groupBy("host").applyInPandas(blend, "host string, settle_ms bigint, scrolls bigint, updated_at bigint")
    return out.orderBy(F.col("updated_at").desc(), "host").limit(cap)


def quiet_waits(mutations: DataFrame, waits: DataFrame, quiet_ms: int = 400, cap_ms: int = 2000) -> DataFrame:
    """waits (scan_id, wait_no, start_ms), mutations (scan_id, wait_no, ts_ms) -> scan_id, wait_no, settle_ms, end_ms, capped, n.

    A wait ends once nothing changed for quiet_ms, counted from its start or the last change, at cap_ms after its start
    at the latest. settle_ms: from the start to the last change before the end; n: changes by then. Waits without any
    change are there, too; changes of no wait, null times and those before the start go.
    """
    found = mutations.where("ts_ms is not null").join(waits.select("scan_id", "wait_no", "start_ms"), ["scan_id", "wait_no"]).where("ts_ms >= start_ms and ts_ms < start_ms + " + str(cap_ms))
    w = W.partitionBy("scan_id", "wait_no").orderBy("ts_ms")
    gap = (F.col("ts_ms") - F.coalesce(F.lag("ts_ms").over(w), F.col("start_ms"))) >= quiet_ms
    # what comes behind the first gap is not of the wait
    inside = found.withColumn("_over", F.max(gap.cast("int")).over(w.rangeBetween(W.unboundedPreceding, 0))).where("_over = 0")
    per = inside.groupBy("scan_id", "wait_no").agg(F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))
    out = waits.join(per, ["scan_id", "wait_no"], "left")
    last = F.coalesce(F.col("last_ms"), F.col("start_ms"))
    end = F.least(last + quiet_ms, F.col("start_ms") + cap_ms)
    return out.select("scan_id", "wait_no", (last - F.col("start_ms")).alias("settle_ms"), end.alias("end_ms"), (last + quiet_ms >= F.col("start_ms") + cap_ms).alias("capped"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
