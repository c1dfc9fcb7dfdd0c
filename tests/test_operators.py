"""Folds, grammars and streams against small references."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenweft.operators import deepscan, extract, near_dup, queue
from lumenweft.operators import media as M


def test_srcset_grammar():
    split = extract.split_srcset
    assert split("a.jpg 1x, b.jpg 2x") == ["a.jpg 1x", "b.jpg 2x"]
    assert split("https://c/w_1,h_2/a.jpg 300w,b.jpg, c.jpg 2x") == ["https://c/w_1,h_2/a.jpg 300w", "b.jpg", "c.jpg 2x"]
    assert split("data:image/png;base64,AA== 1x, b") == ["data:image/png;base64,AA== 1x", "b"]
    assert split("") == split(None) == split(" , ,") == []


def test_backgrounds():
    assert extract.backgrounds('image-set(url("a.png") 1x, url(b.png) 2x, "c.png" 2x), url(d.png)') == ["c.png", "d.png"]
    assert extract.backgrounds("none") == extract.backgrounds(None) == []


def test_elements_and_images(spark):
    html = """<html><head><meta property="og:image" content="/hero.jpg"><link rel="preload" as="image" href="p.jpg" imagesrcset="q.jpg 1x, r.jpg 2x"></head><body>
    <picture><source srcset="s1.jpg 100w, s2.jpg 200w"><img src="i.jpg" data-src="lazy.jpg"></picture><div style="background-image: url('bg.png')"></div>
    <video src="v.mp4" poster="https://x/p.jpg" title="T"><source src="w.webm" type="video/webm"></video><noscript>&lt;img src=&quot;n.jpg&quot;&gt;</noscript></body></html>"""
    pages = spark.createDataFrame([(1, "https://a.example/d/x", html), (2, "https://a.example/", None)], "page_id long, url string, html string")
    e = extract.elements(pages).cache()
    urls = lambda df: [r["src"] for r in df.collect()]
    assert urls(extract.image_urls(e).orderBy("elem_ordinal", "sub_ordinal")) == [f"https://a.example/d/{x}" for x in ("s2.jpg", "s1.jpg", "lazy.jpg", "i.jpg")]
    assert urls(extract.css_backgrounds(e)) == ["https://a.example/d/bg.png"]
    assert urls(extract.hero_images(e)) == ["https://a.example/hero.jpg"]
    assert urls(extract.preloads(e).orderBy("sub_ordinal")) == ["https://a.example/d/p.jpg", "https://a.example/d/r.jpg"]
    assert [(r["src"], r["type"]) for r in extract.av_sources(e).orderBy("sub_ordinal").collect()] == [("https://a.example/d/v.mp4", "mp4"), ("https://a.example/d/w.webm", "webm")]
    assert urls(extract.noscript_images(pages)) == ["https://a.example/d/n.jpg"]
    assert urls(extract.main_image(pages)) == ["https://a.example/hero.jpg"]


def test_scan_dedup_counter_example(spark):
    rows = [(1, 1, "https://a.b/k1.jpg", "m1"), (1, 2, "https://a.b/k2.jpg", "m1"), (1, 3, "https://a.b/k2.jpg", "m2")]
    df = spark.createDataFrame(rows, "page_id long, seq long, src string, media_key string")
    assert sorted(r["seq"] for r in M.scan_dedup(df).collect()) == [1, 3]


def test_unique_names_probe_past_taken(spark):
    plan = spark.createDataFrame([(1, i, p) for i, p in enumerate(["a.jpg", "a-2.jpg", "A.jpg", "d/x", "d/x"])], "batch_id int, seq int, path string")
    got = [r["unique_path"] for r in M.unique_names(plan).orderBy("seq").collect()]
    assert got == ["a.jpg", "a-2.jpg", "A-3.jpg", "d/x", "d/x-2"]


def greedy(items, t):
    clusters = []
    for seq, h in items:
        for c in clusters:
            if all((h ^ m).bit_count() <= t for _, m in c):
                c.append((seq, h))
                break
        else:
            clusters.append([(seq, h)])
    return {s: c[0][0] for c in clusters for s, _ in c}


def test_clusters_equal_global_greedy(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    items = [(i, rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6)))) for i in range(150)]
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in items], "seq long, hi long, lo long")
    assert {r["seq"]: r["cluster"] for r in near_dup.clusters(df, 8).collect()} == greedy(items, 8)


def test_perceptual_hash(spark):
    def field(seed):
        waves = np.cos(np.pi / 32 * (np.arange(32)[None, :] + 0.5) * np.arange(8)[:, None])
        return 128 + waves.T @ np.random.default_rng(seed).normal(0, 8, (8, 8)) @ waves

    noisy = field(1) + np.random.default_rng(2).normal(0, 1, (32, 32))
    df = spark.createDataFrame([(0, field(1).ravel().tolist()), (1, noisy.ravel().tolist()), (2, field(9).ravel().tolist()), (3, None)], "i int, gray array<double>")
    h = {r["i"]: r["p_hash"] for r in near_dup.hashed(df).collect()}
    distance = lambda a, b: (int(h[a], 16) ^ int(h[b], 16)).bit_count()
    assert h[3] is None and distance(0, 1) <= 8 and distance(0, 2) > 20


def events(n, seed):
    rng = random.Random(seed)
    kinds = ["enqueue"] * 3 + ["claim"] * 3 + ["active", "complete", "interrupted", "retry", "recover", "pause", "resume", "cancel", "clear_finished"]
    return [(f"q{rng.randrange(3)}", i, i * 900, rng.choice(kinds), f"i{rng.randrange(12)}", f"u{rng.randrange(9)}", "f", rng.randrange(12), rng.choice([None, "SERVER_FORBIDDEN", "USER_CANCELED"])) for i in range(n)]


EVENT = "queue_id string, seq long, now_ms long, event string, id string, url string, filename string, download_id long, error string"


def test_queue_never_exceeds_concurrency_and_backs_off():
    q = queue.Queue(concurrency=2)
    for i in range(5):
        q.enqueue(0, f"i{i}", f"u{i}", "f")
    assert [q.claim(0) is not None for _ in range(3)] == [True, True, False]
    q.apply("interrupted", 100, id="i0", error="NETWORK_FAILED")
    i0 = q._one("id", "i0")
    assert (i0["status"], i0["ready_at"]) == ("queued", 1100)
    q.apply("interrupted", 100, id="i0", error="X")
    q.apply("interrupted", 100, id="i0", error="X")
    assert i0["status"] == "failed" and [queue.backoff_ms(n) for n in (1, 2, 6)] == [1000, 2000, 30000]
    q.apply("recover", 20_000)
    assert q._one("id", "i1")["status"] == "queued"


def test_queue_stream_equals_batch(spark, tmp_path):
    from lumenweft.streaming.stateful import queue_stream

    rows = events(240, 5)
    want = queue.fold(spark.createDataFrame(rows, EVENT)).select("queue_id", "place", "id", "status", "attempts").toPandas()
    folder = str(tmp_path / "in")
    for k in range(3):  # three files: three batches
        spark.createDataFrame(rows[k * 80 : (k + 1) * 80], EVENT).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    got: dict = {}

    def keep(df, _):
        for key, part in df.toPandas().groupby("queue_id"):
            got[key] = part

    run = queue_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).start()
    run.processAllAvailable()
    run.stop()
    out = pd.concat(got.values())[["queue_id", "place", "id", "status", "attempts"]]
    order = ["queue_id", "place"]
    assert out.sort_values(order).astype(str).values.tolist() == want.sort_values(order).astype(str).values.tolist()


def test_deep_scan_stops():
    def run(rounds, **limits):
        s = deepscan.Scan(**limits)
        for k, media in enumerate(rounds):
            s.round(k * 100, 300, False, False, [(m, False, None) for m in media])
        return s

    assert run([["a"], ["b"], [], [], []]).reason == "complete"
    assert run([["a"], ["b", "c"], ["d"]], max_items=3).reason == "max-items"
    rich = run([["a"]] + [[f"{k}-{j}" for j in range(5)] for k in range(60)], max_scrolls=10, max_ms=10**9)
    assert rich.cap == 20 and rich.rounds == 20 and rich.reason == "max-scrolls"


def test_merge_is_order_invariant(spark):
    rows = [(i, 0, f"https://a.b/{i % 5}.jpg?t={i}", (i * 7) % 11, (i * 3) % 7, i) for i in range(40)]
    cols = "seq long, page_id long, src string, width int, height int, file_size long"
    one = M.keep_largest(spark.createDataFrame(rows, cols)).select("seq", "slot").toPandas()
    random.Random(1).shuffle(rows)
    two = M.keep_largest(spark.createDataFrame(rows, cols)).select("seq", "slot").toPandas()
    assert sorted(map(tuple, one.values)) == sorted(map(tuple, two.values))


def test_plan_prunes_html(spark, sf):
    from lumenweft.plans.pages import page_host

    plan = page_host(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[1][:200]


def test_backup_round_trip(spark):
    from lumenweft.operators import stores

    docs = spark.createDataFrame([(1, '{"app":"lw","version":2,"history":[{"src":"https://a/b.jpg","time":5,"sourcePage":{"url":"javascript:x","title":"t"}},{"src":""}],"excluded":[{"value":"a.b","kind":"host","time":1},{"value":"z","kind":"odd"}]}'), (2, "no json"), (3, '{"app":"other"}')], "id int, body string")
    got = {r["id"]: r["backup"] for r in stores.read_backups(docs, "lw").collect()}
    assert got[2] is None and got[3] is None
    assert [e["src"] for e in got[1]["history"]] == ["https://a/b.jpg"] and got[1]["history"][0]["sourcePage"]["url"] == "" and len(got[1]["excluded"]) == 1


def test_empty_tables(spark, sf):
    from lumenweft.plans.media import items

    none = items(spark, sf).where(F.lit(False))
    assert M.toolbar(none, M.Toolbar()).count() == M.facets(none).count() == M.keep_largest(none).count() == M.scan_dedup(none).count() == 0
