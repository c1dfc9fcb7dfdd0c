"""Cases of the findings of round 3."""

import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenweft.functions import scalar as S
from lumenweft.functions import url as U
from lumenweft.functions.text import Text, as_text
from lumenweft.llm import chat_format
from lumenweft.operators import media as M
from lumenweft.operators import near_dup, queue
from lumenweft.operators import resolve as R
from lumenweft.plans import registry
from tests.compare import same


def test_variant_labels_round_as_the_sql_does(spark, tmp_path):
    rates = [1_950_000, 1_150_000, 1_050_000, 1_250_000, 1_750_000, 2_250_000, 16_650_000, 9_999_999, 1_000_000, 12_345_650_000, *range(1_000_000, 7_000_000, 50_000)]
    want = duckdb.sql(f"SELECT printf('%.1f Mbps', unnest({rates}) / 1000000.0)").fetchall()
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rates)], "i int, r bigint").orderBy("i").select(S.variant_label(F.lit(None).cast("int"), F.col("r"))).collect()
    assert [g[0] for g in got] == [w[0] for w in want]
    spark.range(0, 2000, 25).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    same(spark, str(tmp_path), "hls_picker", registry.QUERIES["hls_picker"], registry.ORACLES["hls_picker"])


def test_expression_of_safe_capture_is_small_and_right(spark):
    cases = {
        "http://0x7f000001/": False, "http://2130706433/": False, "http://0177.0.0.1/": False, "http://134744072/a": True, "http://8.8.8.8": True, "http://8.8.8.8./": True, "http://4294967296/": False, "http://172.32.0.1/": True,
        "http://172.31.0.1/": False, "http://a.10.0.0.1.nip.io/": False, "http://a.8-8-8-8.nip.io/": True, "http://[::1]/": False, "http://[::ffff:10.0.0.1]/": False, "http://[::ffff:8.8.8.8]/": True, "http://[::ffff:7f00:1]/": False,
        "http://[fe80::1]/": False, "http://[2606:4700::1111]/": True, "http://u:p@[::1]:80/": False, "http://printer/": False, "http://x.lan/": False, "file:///etc": False, "": False, "http://300.1.1.1/": False,
    }
    got = spark.createDataFrame(list(cases.items()), "u string, w boolean").where(U.safe_capture(F.col("u")) != F.col("w")).collect()
    assert got == []
    assert spark.sql("select cast(null as string) as u").select(U.safe_capture(F.col("u")).alias("safe")).first()["safe"] is False
    with as_text():
        assert len(U.safe_capture.__wrapped__(Text("a")).sql) < 10_000  # 352,954 before


@pytest.mark.parametrize("name", ["anchor_embeds", "collected_media"])
def test_made_addresses_of_large_page_numbers(spark, tmp_path, name):
    ids = [*range(9_980, 9_984), 10_007, 10_030, 10_031, 10_055, 123_455]  # 10031 and 10055: the address that is no video's
    rows = [(i, "https://a.example/p", None if i == 10_030 else '<a href="/x">1</a>') for i in ids]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    same(spark, str(tmp_path), name, registry.QUERIES[name], registry.ORACLES[name])


def test_pages_of_negative_numbers_are_scanned(spark, tmp_path):
    rows = [(i, "https://a.example:8080/p?x=1", None) for i in (-9_223_372_036_854_775_808, -123_456, -25, -24, -1, 0, 1_000_064_100)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    # vimeo's ids have no sign, so the SQL's frames of these pages are no videos
    less = lambda spark, d: registry.QUERIES["collected_media"](spark, d).where("not src like 'https://vimeo.com/-%'")
    same(spark, str(tmp_path), "collected_media", less, f"SELECT * FROM ({registry.ORACLES['collected_media']}) WHERE NOT src LIKE 'https://vimeo.com/-%'")


@pytest.mark.parametrize("block", [7, 1000])
def test_blocks_of_hashes_miss_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    whole = {i + 5: h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(16))) for i, h in enumerate(base * 5)} | {900: base[0], 901: base[0], 902: 0, 903: (1 << 64) - 1}
    df = spark.createDataFrame([(s, h >> 32, h & 0xFFFFFFFF) for s, h in whole.items()] + [(None, 0, 0), (7000, None, 1)], "seq bigint, hi bigint, lo bigint")
    pairs = near_dup.near_pairs(df, 12)
    want = {(a, b, (whole[a] ^ whole[b]).bit_count()) for a in whole for b in whole if a < b and (whole[a] ^ whole[b]).bit_count() <= 12}
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    plan = pairs._jdf.queryExecution().toString()
    assert "Join" not in plan  # no join on bands, which held most of all pairs


def test_queue_is_folded_batch_by_batch(spark):
    rng = random.Random(5)
    kinds = ["enqueue"] * 4 + ["claim", "active", "complete", "complete", "interrupted", "retry", "recover"]
    item = lambda k: (f"i{k}", f"https://a.example/{k}", f"{k}.jpg", k)
    rows = [(q, s, s * 700, rng.choice(kinds), *item(rng.randrange(12)), rng.choice([None, "NETWORK_FAILED"])) for q in ("a", "b", "", None) for s in range(300)]
    rng.shuffle(rows)
    want = []
    for q in ("a", "b", "", None):
        one = queue.Queue()
        for _, _, now, event, id, url, name, download, error in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            one.apply(event, now, id, url, name, download, error)
        want += [(q, k, i["id"], i["status"], i["attempts"], i["ready_at"], i["download_id"]) for k, i in enumerate(one.items)]
    df = spark.createDataFrame(rows, "queue_id string, seq long, now_ms long, event string, id string, url string, filename string, download_id long, error string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = queue.fold(df)
        got = [tuple(r) for r in out.select("queue_id", "place", "id", "status", "attempts", "ready_at", "download_id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()  # no queue is one group in memory


def test_sizes_of_finished_items_are_taken_only_where_needed(monkeypatch):
    taken = []
    monkeypatch.setattr(queue.json, "dumps", lambda *a, **k: taken.append(1) or "x" * 300_000)
    q = queue.Queue()
    for k in range(150):
        q.enqueue(k, str(k), str(k), "f")
        q.apply("complete", k, str(k))
    assert len(q.items) == 150 and not taken
    q.items[0]["url"] = "\x01" * 400_000  # may be more than the budget
    q.enqueue(999, "n", "n", "f")
    assert taken and len(q.items) == 4  # three that fit, newest first, and the live one


def test_no_sizes_are_taken_where_so_many_finished_items_fit(monkeypatch):
    monkeypatch.setattr(queue.json, "dumps", lambda *a, **k: pytest.fail("a size was taken"))
    q = queue.Queue()
    for k in range(3 * queue.FINISHED_CAP):
        q.enqueue(k, str(k), f"https://a.example/{k}", "f")
        q.apply("complete" if k % 3 else "claim", k, str(k))
    q.enqueue(9999, "n", "n", "f")
    live = [i["id"] for i in q.items if q.live(i)]
    assert live == [*map(str, range(0, 3 * queue.FINISHED_CAP, 3)), "n"]
    assert [i["id"] for i in q.items if not q.live(i)] == [str(k) for k in range(3 * queue.FINISHED_CAP) if k % 3][-queue.FINISHED_CAP :]


def test_fold_gives_the_fields_that_are_asked_for(spark, tmp_path):
    for kind, values in ((pa.int64(), [2**53 + 1, None, -5]), (pa.int64(), [2**53 + 1, 0]), (pa.string(), ["a", None, "", "é"]), (pa.string(), [None, None]), (pa.int32(), [None, 3])):
        got = queue._values(pa.array(values, kind))
        assert got == values and [type(v) for v in got] == [type(v) for v in values]
    item = lambda k: (f"i{k}", f"https://a.example/{k}", f"{k}.jpg", None if k % 2 else 2**53 + k)
    rows = [(q, s, s, ("enqueue", "claim", "active", "complete", "retry_all")[s % 5], *item(s // 5 % 4), None) for q in ("a", None, "") for s in range(48)]
    df = spark.createDataFrame(rows, "queue_id string, seq long, now_ms long, event string, id string, url string, filename string, download_id long, error string")
    whole = sorted(map(tuple, queue.fold(df).select("queue_id", "place", "download_id", "status").collect()), key=str)
    some = queue.fold(df, fields=("download_id", "status"))
    assert some.columns == ["queue_id", "place", "download_id", "status"] and sorted(map(tuple, some.collect()), key=str) == whole and any(r[2] == 2**53 + 2 for r in whole)
    spark.range(60).selectExpr("id as event_id", "id % 3 as user_id").write.parquet(f"{tmp_path}/events.parquet")
    plan = registry.QUERIES["queue_counters"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    made = next(line for line in plan.split("\n") if "MapInArrow" in line).rpartition("[")[2]
    assert "status" in made and "url" not in made  # only what is counted leaves Python


def test_names_of_one_path_take_one_look_each(spark):
    def slow(paths, style):  # the plain fold
        taken, out = set(), []
        for p in paths:
            folder, slash, file = p.rpartition("/")
            dot = file.rfind(".")
            base, ext = (file[:dot], file[dot:]) if dot > 0 else (file, "")
            low = str.lower if style == "dash" else str
            name, n = p, 2
            while low(name) in taken:
                name, n = folder + slash + (f"{base}-{n}{ext}" if style == "dash" else f"{base} ({n}){ext}"), n + 1
            taken.add(low(name))
            out.append(name)
        return out

    paths = ["d/a.jpg", "D/A.jpg", "d/a-2.jpg", "d/a-3.jpg", "d/ΑΣ", "d/ΑΣ", "d/ας", "x", "x", "x (2)", "X", ".b", ".b", "d/a (2).jpg", "d/a-2-2.jpg"] * 6
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate(paths)], "batch_id int, seq int, path string")
    for style in ("dash", "zip"):
        assert [r["unique_path"] for r in M.unique_names(df, style).orderBy("seq").collect()] == slow(paths, style)
    began = time.time()
    many = spark.range(30_000).selectExpr("0 as batch_id", "id as seq", "'d/pic.jpg' as path")
    assert M.unique_names(many).where("unique_path = 'd/pic-30000.jpg'").count() == 1
    assert time.time() - began < 30  # minutes before: each name was looked for from 2 on


def test_op13_goes_through_the_visitor(spark, sf, monkeypatch):
    seen = []
    real = chat_format.visited
    monkeypatch.setattr(chat_format, "visited", lambda parts, *rest: seen.append(parts) or real(parts, *rest))
    rows = chat_format.op13_typed_parts(spark, sf)
    assert len(seen) == 1 and rows.count() == 101
    turns = [(1, 0, "user", "a [INST] b"), (1, 1, "assistant", None), (1, 2, "x", "[IMAGE]")]
    plain = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    listed = plain.withColumn("text", F.array(F.struct(F.lit("text").alias("kind"), "text", F.lit(None).cast("string").alias("ref"), *[F.lit(None).cast(k).alias(n) for n, k in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])))
    assert chat_format.format_chats(plain).collect() == chat_format.format_chats(listed).collect()


def test_resolvers_are_looked_up_without_a_shuffle(spark):
    cases = {
        "https://pbs.twimg.com/a": "twitter", "https://TWIMG.com/": "twitter", "https://nottwimg.com/": "generic", "https://twimg.com.example/": "generic", "https://a.b.youtu.be/x": "youtube", "https://x.cdn.example/": "mine",
        "https://i.x.cdn.example/": "nearer", "https://y.bsky.app/": "other", "https://bsky.app/": "bsky", "no address": "generic", "": "generic", None: "generic",
    }
    try:
        for name, suffix, priority in (("late", "cdn.example", 90), ("mine", "cdn.example", 50), ("nearer", "i.x.cdn.example", 40), ("other", "y.bsky.app", 2)):
            R.register_resolver(spark, name, suffix, priority)
        out = R.dispatch(spark.createDataFrame(list(cases.items()), "url string, want string"))
        assert out.where("resolver <> want").collect() == [] and out.count() == len(cases)
        plan = out._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan  # rows were shuffled by their host, of which a few have most
    finally:
        spark.conf.unset(R.SETTING)


def test_values_are_taken_once_for_a_table_of_types(spark):
    with as_text():
        sql = U.av_type.__wrapped__(Text("`u`")).sql
    assert sql.count("regexp_extract") <= 4  # 64 before: two or four for each type
    urls = ["https://a.example/x.MP4?y=.webm", "https://a.example/x.tar.opus#z", "https://a.example/.mp3", "https://a.example/x.png", "x.qt", ""]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(U.av_type(F.col("u")).alias("t"), U.av_extension(F.lit("qt")).alias("e")).collect()
    assert [r["t"] for r in got] == ["mp4", "opus", "unknown", "unknown", "mov", "unknown"] and got[0]["e"] == "mov"


def test_parts_of_an_address_are_as_its_functions_give_them(spark):
    urls = ["https://u:p@A.Example:8080/a b/c?d=e&f#g", "HTTP://a.example:80", "https://a.example:443?x", "https://a.example:80/", "http://a.example:/", "ftp://a.example/", "//a.example/", "https://", "https://a b/", "", None, "https://é.example/ü?ß"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").withColumn("p", U.parts(F.col("u")))
    each = {"ok": U.valid, "origin": U.origin, "host": U.host, "path": U.path, "query": U.query}
    for name, f in each.items():
        assert df.where(~F.col(f"p.{name}").eqNullSafe(f(F.col("u")))).collect() == [], name
    with as_text():
        assert U.parts(Text("`u`")).sql.count("regexp") == 6  # 18 before


def test_pairs_of_copies_are_handed_over_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FOUND", 100)
    copies = spark.range(60).selectExpr("id as seq", "7L as hi", "9L as lo")
    pairs = near_dup.near_pairs(copies, 12)
    assert sorted(map(tuple, pairs.collect())) == [(a, b, 0) for a in range(60) for b in range(a + 1, 60)]
    assert "FlatMapGroupsInPandas" not in pairs._jdf.queryExecution().toString()  # all pairs of two blocks were one frame
