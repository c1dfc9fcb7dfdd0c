"""Queries over the events table, read as queue, scan and history activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.functions import scalar as S
from lumenweft.operators import bounded as B
from lumenweft.operators import deepscan as D
from lumenweft.operators import queue as Q
from lumenweft.operators import stores as T
from lumenweft.operators.media import merge_entries
from lumenweft.sources.shared import scratch
from lumenweft.sources.versioned import Store

KINDS = ("enqueue", "claim", "active", "complete", "interrupted", "retry", "recover")


def events(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def queue_events(spark, d) -> DataFrame:
    """Each user a queue; what happens follows from the event's number."""
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(F.hash("event_id"), F.lit(len(KINDS))) + 1).cast("int"))
    item = (e % 20).cast("string")
    return events(spark, d).select(
        F.col("user_id").cast("string").alias("queue_id"), e.alias("seq"), (e * 700).alias("now_ms"), kind.alias("event"), item.alias("id"), F.concat(F.lit("https://a.example/"), item).alias("url"), F.concat(item, F.lit(".jpg")).alias("filename"),
        (e % 20).cast("bigint").alias("download_id"), F.when(e % 3 == 0, "NETWORK_FAILED").alias("error"),
    )


def queue_fold(spark, d):
    return Q.fold(queue_events(spark, d), fields=("id", "status", "attempts", "ready_at"))


def queue_counters(spark, d):
    return Q.counters(Q.fold(queue_events(spark, d), fields=("status",)))


def backoff_schedule(spark, d):
    n = (F.col("event_id") % 12 + 1).cast("int")
    return events(spark, d).select("event_id", S.backoff_ms(n).alias("wait_ms"), S.backoff_ms(n, 15_000).alias("short_ms"))


def scan_memory_ema(spark, d):
    s = events(spark, d).select(F.concat(F.lit("h"), (F.col("user_id") % 50).cast("string")).alias("host"), F.col("event_id").alias("time_ms"), (F.col("event_id") * 37 % 3000).cast("double").alias("settle_ms"), (F.col("event_id") % 60).cast("double").alias("scrolls"))
    return D.memory(s)


def deep_scan_rounds(spark, d):
    e = F.col("event_id")
    r = events(spark, d).select(
        (F.col("user_id") % 40).cast("string").alias("scan_id"), (e % 30).cast("int").alias("round_no"), (e % 30 * 500).alias("now_ms"), ((e % 30) * 41 % 900).cast("double").alias("settle_ms"), F.lit(False).alias("at_bottom"), F.lit(False).alias("aborted"),
        F.concat(F.lit("m"), (e * 13 % 400).cast("string")).alias("identity"), (e % 5 == 0).alias("keyed"), e.alias("seq"),
    )
    return D.scans(r)


def quiet_waits(spark, d):
    """Every event a change during one of its scan's 25 waits."""
    wait = F.col("event_id") % 25
    m = events(spark, d).select((F.col("user_id") % 40).cast("string").alias("scan_id"), wait.cast("int").alias("wait_no"), (wait * 100_000).alias("start_ms"), (wait * 100_000 + F.col("event_id") * 97 % 9000).alias("ts_ms"))
    return D.quiet_waits(m.drop("start_ms"), m.select("scan_id", "wait_no", "start_ms").distinct())


def settings_overlay(spark, d):
    u = events(spark, d).select(F.col("user_id")).distinct()
    host = F.concat(F.lit("h"), F.col("user_id").cast("string"))
    settings = u.select(host.alias("host"), (F.col("user_id") * 3).cast("string").alias("minimum_image_size"), F.lit("x").alias("concurrency"))
    overrides = u.where("user_id % 2 = 0").select(host.alias("host"), F.lit("concurrency").alias("field"), F.col("user_id").cast("string").alias("value"))
    return T.effective(settings, overrides)


def store_heal(spark, d):
    u = events(spark, d).select("user_id").distinct()
    key = F.col("user_id").cast("string").alias("key")
    return T.healed(u.where("user_id % 2 = 0").select(key, F.when(F.col("user_id") % 4 == 0, "local").alias("value")), u.where("user_id % 3 = 0").select(key, F.lit("mirror").alias("value")))


def puts(spark, d) -> DataFrame:
    """Forty users a tab; each event a put of one of 1,700 keys by one of the passes that overlap, some a close of the tab."""
    e = F.col("event_id")
    return events(spark, d).select(
        F.floor(F.col("user_id") / 40).cast("string").alias("store_id"), e.alias("seq"), F.when(e % 2999 != 0, F.concat(F.lit("m"), (e * 7919 % 1700).cast("string"))).alias("key"), F.concat(F.lit("https://v.example/"), e.cast("string"), F.lit(".mp4")).alias("value"),
        F.when(e % 3 != 0, F.floor(e / 50).cast("bigint") - F.when(e % 7 == 0, 1).otherwise(0)).alias("generation"),
    )


def sniffed_stores(spark, d):
    return B.first_in(puts(spark, d))


def product_stores(spark, d):
    return B.most_recent(puts(spark, d))


def restarted_queue(spark, d):
    """Each event an item of its user's queue as a restart finds it, and what was downloaded meanwhile."""
    e, no = F.col("event_id"), F.lit(None)
    url, status = F.concat(F.lit("https://a.example/"), (e % 5000).cast("string")), F.element_at(F.array(*map(F.lit, ("active", "active", "queued", "done", "failed"))), (e % 5 + 1).cast("int"))
    items = events(spark, d).select(
        F.col("user_id").cast("string").alias("queue_id"), e.cast("int").alias("place"), e.cast("string").alias("id"), url.alias("url"), F.lit("f.jpg").alias("filename"), status.alias("status"), (e % 3).cast("int").alias("attempts"), no.cast("string").alias("error"),
        F.when(e % 5 == 1, e).alias("download_id"), F.when(e % 4 != 0, 1_000_000 - e % 20 * 1000).alias("claimed_at"), F.lit(5).cast("bigint").alias("ready_at"), e.alias("added_at"), F.lit(False).alias("use_referer"), F.lit(7).cast("bigint").alias("bytes_received"), F.lit(9).cast("bigint").alias("total_bytes"),
    )
    state = F.element_at(F.array(*map(F.lit, ("complete", "in_progress", "interrupted"))), (e * 7 % 11 % 3 + 1).cast("int"))
    downloads = events(spark, d).where(e % 4 > 0).select(url.alias("url"), e.alias("download_id"), state.alias("state"), (e * 31 % 1009).alias("start_ms"))
    return Q.reconciled(items, downloads, 1_000_000).select("id", "status", "attempts", "error", "download_id", "claimed_at", "ready_at", "bytes_received", "finished")


def _batches(rows: DataFrame, store: Store, merge) -> None:
    """rows in three batches of one writer, by event; the first once more after the second, and the last twice."""
    for number in (0, 1, 0, 2, 2):
        store.put(rows.where(F.col("seq") % 3 == number), merge, "events", number)


def versioned_history(spark, d):
    """Every event a download of its user, written to a store of histories in batches and read back."""
    e = F.col("event_id")
    rows = events(spark, d).select(F.col("user_id").alias("user"), F.concat(F.lit("https://a.example/"), (e * 7919 % 400).cast("string"), F.lit(".jpg")).alias("src"), (e * 31 % 100_003).alias("time_ms"), e.alias("seq"))
    store = Store(spark, scratch(spark, "history"), rows.schema.simpleString()[7:-1].replace(":", " "), F.col("user"), 16)
    _batches(rows, store, lambda held, added: merge_entries(held, added, partition=("user",)))
    return store.read()


def collected_store(spark, d):
    """Every event an item of a store that keeps the first of each address, and the version that brought it."""
    e = F.col("event_id")
    rows = events(spark, d).select(F.concat(F.lit("https://a.example/"), (e * 7919 % 20_011).cast("string"), F.lit(".jpg")).alias("src"), F.col("user_id").alias("user"), e.alias("seq"))
    store = Store(spark, scratch(spark, "collected"), rows.schema.simpleString()[7:-1].replace(":", " "), T.U.canonical_key(F.col("src")), 16)
    _batches(rows, store, T.first_seen)
    versions = [store.added(v, ["src"]).withColumn("version", F.lit(v)) for v in range(1, store.manifest().version + 1)]
    return versions[0].unionAll(versions[1]).unionAll(versions[2])


QUERIES = {f.__name__: f for f in (queue_fold, queue_counters, backoff_schedule, scan_memory_ema, deep_scan_rounds, quiet_waits, settings_overlay, store_heal, sniffed_stores, product_stores, restarted_queue, versioned_history, collected_store)}
_PUTS = """p AS (SELECT user_id // 40 AS store, event_id AS seq, CASE WHEN event_id % 2999 <> 0 THEN event_id * 7919 % 1700 END AS k, CASE WHEN event_id % 3 <> 0 THEN event_id // 50 - CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END END AS gen FROM events),
c AS (SELECT * FROM p QUALIFY k IS NULL OR gen IS NULL OR gen >= max(gen) OVER (PARTITION BY store ORDER BY seq))"""
ORACLES = {
    "versioned_history": """SELECT user_id AS user, 'https://a.example/' || (event_id * 7919 % 400) || '.jpg' AS src, event_id * 31 % 100003 AS time_ms, event_id AS seq FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_id * 7919 % 400 ORDER BY event_id % 3 DESC, event_id * 31 % 100003 DESC, event_id) = 1""",
    "collected_store": """SELECT 'https://a.example/' || (event_id * 7919 % 20011) || '.jpg' AS src, user_id AS user, event_id AS seq, CAST(event_id % 3 + 1 AS INTEGER) AS version FROM events
QUALIFY row_number() OVER (PARTITION BY event_id * 7919 % 20011 ORDER BY event_id % 3, event_id) = 1""",
    # keys in order of age, a put at a time
    "sniffed_stores": f"""WITH RECURSIVE {_PUTS}, n AS MATERIALIZED (SELECT store, k, row_number() OVER (PARTITION BY store ORDER BY seq) AS i FROM c), last AS (SELECT store, k, max(seq) AS seq FROM c GROUP BY ALL), size AS MATERIALIZED (SELECT store, max(i) AS most FROM n GROUP BY store),
f AS (SELECT store, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS keys FROM size
  UNION ALL SELECT f.store, n.i, CASE WHEN n.k IS NULL THEN CAST([] AS BIGINT[]) WHEN list_contains(f.keys, n.k) THEN f.keys WHEN len(f.keys) >= 800 THEN list_append(f.keys[2:], n.k) ELSE list_append(f.keys, n.k) END FROM f JOIN n ON n.store = f.store AND n.i = f.i + 1),
o AS (SELECT f.store, unnest(keys) AS k, unnest(range(1, len(keys) + 1)) AS place FROM f JOIN size ON size.store = f.store AND most = i)
SELECT CAST(o.store AS VARCHAR) AS store_id, place, 'm' || o.k AS key, 'https://v.example/' || last.seq || '.mp4' AS value FROM o JOIN last ON last.store = o.store AND last.k = o.k""",
    "product_stores": f"""WITH {_PUTS}, z AS (SELECT store, max(seq) AS closed FROM c WHERE k IS NULL GROUP BY store), l AS (SELECT store, k, max(seq) AS seq FROM c WHERE k IS NOT NULL GROUP BY ALL),
h AS (SELECT l.*, row_number() OVER (PARTITION BY l.store ORDER BY seq DESC) AS n FROM l LEFT JOIN z ON z.store = l.store WHERE closed IS NULL OR seq > closed)
SELECT CAST(store AS VARCHAR) AS store_id, row_number() OVER (PARTITION BY store ORDER BY n DESC) AS place, 'm' || k AS key, 'https://v.example/' || seq || '.mp4' AS value FROM h WHERE n <= 200""",
    "restarted_queue": """WITH d AS (SELECT event_id % 5000 AS u, event_id AS did, (['complete', 'in_progress', 'interrupted'])[event_id * 7 % 11 % 3 + 1] AS state, event_id * 31 % 1009 AS start_ms FROM events WHERE event_id % 4 > 0),
a AS (SELECT * FROM d WHERE state <> 'interrupted' QUALIFY row_number() OVER (PARTITION BY u ORDER BY start_ms, did) = 1),
i AS (SELECT event_id AS e, event_id % 5 AS s, event_id % 3 AS attempts, CASE WHEN event_id % 4 <> 0 THEN 1000000 - event_id % 20 * 1000 END AS claimed FROM events),
j AS (SELECT i.*, s = 0 AND 1000000 - coalesce(claimed, 0) > 10000 AS stuck, a.did AS taken, a.state AS taken_state, d.state AS own FROM i LEFT JOIN a ON a.u = e % 5000 LEFT JOIN d ON d.did = e),
k AS (SELECT *, CASE WHEN stuck AND taken_state = 'complete' OR s = 1 AND own = 'complete' THEN 'done' WHEN stuck AND taken IS NULL THEN 'orphan' WHEN stuck THEN 'adopted' WHEN s = 1 AND coalesce(own, 'interrupted') = 'interrupted' THEN CASE attempts WHEN 2 THEN 'dead' ELSE 'again' END ELSE '' END AS turn FROM j)
SELECT CAST(e AS VARCHAR) AS id, CASE turn WHEN 'done' THEN 'done' WHEN 'orphan' THEN 'queued' WHEN 'again' THEN 'queued' WHEN 'dead' THEN 'failed' ELSE (['active', 'active', 'queued', 'done', 'failed'])[s + 1] END AS status,
  CAST(attempts + CASE WHEN turn IN ('again', 'dead') THEN 1 ELSE 0 END AS INTEGER) AS attempts, CASE WHEN turn = 'dead' THEN 'retry limit reached' END AS error, CASE WHEN turn IN ('again', 'dead') THEN NULL WHEN turn = 'adopted' THEN taken WHEN s = 1 THEN e END AS download_id,
  CASE WHEN turn NOT IN ('orphan', 'adopted') THEN claimed END AS claimed_at, CAST(CASE turn WHEN 'orphan' THEN 1000000 WHEN 'again' THEN 1000000 + 1000 * (attempts + 1) ELSE 5 END AS BIGINT) AS ready_at, CAST(CASE WHEN turn <> 'again' THEN 7 END AS BIGINT) AS bytes_received, turn = 'done' AS finished FROM k""",
    "backoff_schedule": "SELECT event_id, CAST(least(1000 * pow(2, event_id % 12), 30000) AS BIGINT) AS wait_ms, CAST(least(1000 * pow(2, event_id % 12), 15000) AS BIGINT) AS short_ms FROM events",
    "quiet_waits": """WITH m AS (SELECT CAST(user_id % 40 AS VARCHAR) AS scan_id, CAST(event_id % 25 AS INTEGER) AS wait_no, event_id % 25 * 100000 AS start_ms, event_id % 25 * 100000 + event_id * 97 % 9000 AS ts_ms FROM events),
g AS (SELECT *, ts_ms - coalesce(lag(ts_ms) OVER (PARTITION BY scan_id, wait_no ORDER BY ts_ms), start_ms) >= 400 AS gap FROM m WHERE ts_ms < start_ms + 2000),
f AS (SELECT scan_id, wait_no, min(ts_ms) AS cut FROM g WHERE gap GROUP BY ALL),
l AS (SELECT g.scan_id, g.wait_no, max(g.ts_ms) AS last_ms, count(*) AS n FROM g LEFT JOIN f ON f.scan_id = g.scan_id AND f.wait_no = g.wait_no WHERE f.cut IS NULL OR g.ts_ms < f.cut GROUP BY ALL),
w AS (SELECT DISTINCT scan_id, wait_no, start_ms FROM m)
SELECT w.scan_id, w.wait_no, coalesce(l.last_ms, w.start_ms) - w.start_ms AS settle_ms, least(coalesce(l.last_ms, w.start_ms) + 400, w.start_ms + 2000) AS end_ms,
  coalesce(l.last_ms, w.start_ms) + 400 >= w.start_ms + 2000 AS capped, coalesce(l.n, 0) AS n FROM w LEFT JOIN l ON l.scan_id = w.scan_id AND l.wait_no = w.wait_no""",
    "settings_overlay": "SELECT DISTINCT 'h' || user_id AS host, CAST(least(user_id * 3, 10000) AS INTEGER) AS minimum_image_size, CAST(CASE WHEN user_id % 2 = 0 THEN least(20, greatest(1, user_id)) ELSE 5 END AS INTEGER) AS concurrency, 8 AS near_dup_threshold, 40 AS max_scrolls, 20000 AS max_ms FROM events",
    "store_heal": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, CASE WHEN user_id % 4 = 0 THEN 'local' WHEN user_id % 2 = 0 THEN NULL ELSE 'mirror' END AS value FROM events WHERE user_id % 2 = 0 OR user_id % 3 = 0",
}
