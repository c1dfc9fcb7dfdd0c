"""Stores with writers: repeated, lost and competing writes, streams that start again, and what a vacuum leaves."""

import pytest
from pyspark.sql import functions as F

from lumenweft.operators import stores as T
from lumenweft.operators.media import merge_entries
from lumenweft.sources.versioned import Store

ITEM = "src string, kind string, seq bigint"
ADDRESS = "https://a.example/{}.jpg"


def items(spark, *numbers, kind="image"):
    return spark.createDataFrame([(None if n is None else ADDRESS.format(n) if n != "" else "", kind, k, "x") for k, n in enumerate(numbers)], ITEM + ", extra string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), ITEM, T.U.canonical_key(F.col("src")), 5)


def held(df):
    return sorted((r["src"].split("/")[-1][:-4], r["kind"]) for r in df.collect())


def files(store):
    return sorted(store._listed("data")), sorted(store._listed("log"))


def test_first_seen_and_added(spark, store):
    assert held(store.read()) == [] and store.manifest().version == 0
    assert store.put(items(spark, "a", "b", "a", None, ""), T.first_seen, "w", 0) == 1
    assert store.put(items(spark, "b", "c", kind="video"), T.first_seen, "w", 1) == 2
    assert held(store.read()) == [("a", "image"), ("b", "image"), ("c", "video")]
    assert held(store.added(2, ["src"])) == [("c", "video")] and held(store.added(1, ["src"])) == [("a", "image"), ("b", "image")]
    assert held(store.read(1)) == [("a", "image"), ("b", "image")]


def test_repeats_change_nothing(spark, store):
    store.put(items(spark, "a"), T.first_seen, "w", 4)
    store.put(items(spark, "b"), T.first_seen, "other", 0)
    before = files(store)
    assert store.put(items(spark, "z"), T.first_seen, "w", 4) == 1
    assert store.put(items(spark, "z"), T.first_seen, "w", 3) is None
    assert store.clear("w", 4) == 1
    assert files(store) == before and held(store.read()) == [("a", "image"), ("b", "image")]


def test_lost_write(spark, store, monkeypatch):
    store.put(items(spark, "a"), T.first_seen, "w", 0)
    folders = len(store._listed("data"))
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda manifest: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.put(items(spark, "b"), T.first_seen, "w", 1)
    assert held(store.read()) == [("a", "image")] and store.manifest().version == 1
    assert len(store._listed("data")) > folders
    assert store.put(items(spark, "b"), T.first_seen, "w", 1) == 2
    assert held(store.read()) == [("a", "image"), ("b", "image")]
    assert store.vacuum(keep=5) == 0  # within the grace
    assert store.vacuum(keep=5, grace_s=-60) == 2
    assert held(store.read()) == [("a", "image"), ("b", "image")] and held(store.read(1)) == [("a", "image")]


def test_competing_writers(spark, store):
    """The second one's manifest is refused once the first has its version, and it merges again on top."""
    rival = Store(spark, store.path, ITEM, T.U.canonical_key(F.col("src")), 5)
    calls = []

    def slow(old, new):
        if not calls:
            rival.put(items(spark, "a", "r", kind="rival"), T.first_seen, "rival", 0)
        calls.append(1)
        return T.first_seen(old, new)

    assert store.put(items(spark, "a", "b"), slow, "w", 0) == 2
    assert len(calls) == 2
    assert held(store.read()) == [("a", "rival"), ("b", "image"), ("r", "rival")]
    assert held(store.added(2, ["src"])) == [("b", "image")]
    assert all(n.endswith(".json") for n in store._listed("log") if not n.startswith("."))


def test_clear_empty_batches_and_vacuum(spark, store):
    store.put(items(spark, "a", "b", "c", "d"), T.first_seen, "w", 0)
    assert store.put(items(spark), T.first_seen, "w", 1) == 2
    assert len(held(store.read())) == 4
    assert store.clear("w", 2) == 3 and held(store.read()) == []
    assert len(held(store.read(2))) == 4
    assert store.put(items(spark, "e"), T.first_seen, "w", 3) == 4
    store.vacuum(keep=1, grace_s=-60)
    assert held(store.read()) == [("e", "image")] and store._versions() == [4]
    assert store.put(items(spark, "z"), T.first_seen, "w", 3) == 4


def test_only_touched_parts_are_written(spark, store):
    store.put(items(spark, *range(40)), T.first_seen, "w", 0)
    first = store.manifest().parts
    store.put(items(spark, "one"), T.first_seen, "w", 1)
    second = store.manifest().parts
    assert len(first) == 5 and sum(first[p] != second[p] for p in first) == 1


def test_removals(spark, store):
    store.put(items(spark, "a", "b", "c"), T.first_seen, "w", 0)
    store.put(items(spark, "b"), T.removed, "w", 1)
    assert held(store.read()) == [("a", "image"), ("c", "image")]
    store.put(items(spark, "a", "c"), T.removed, "w", 2)
    assert held(store.read()) == [] and store.manifest().parts == {}


def test_a_merge_that_moves_rows(spark, store):
    with pytest.raises(ValueError, match="moved rows"):
        store.put(items(spark, "a"), lambda old, new: old.unionByName(new.withColumn("src", F.explode(F.array(*[F.lit(ADDRESS.format(k)) for k in range(40)])))), "w", 0)
    assert store.manifest().version == 0
    with pytest.raises(ValueError):
        Store(spark, store.path, "__part int", F.col("__part"))


def test_history_of_users(spark, tmp_path):
    """Null users too; a later batch beats what is held, the newest of a batch wins, caps are per user."""
    s = Store(spark, str(tmp_path), "user string, src string, time_ms bigint, seq bigint", F.col("user"), 3)
    rows = lambda *r: spark.createDataFrame([(u, ADDRESS.format(k), t, n) for n, (u, k, t) in enumerate(r)], s.schema)
    merge = lambda old, new: merge_entries(old, new, cap=2, partition=("user",))
    s.put(rows(("u", "a", 5), ("u", "b", 6), (None, "a", 1), ("u", "b", 4)), merge, "w", 0)
    s.put(rows(("u", "a", 3), ("u", "c", 7), (None, "b", 2)), merge, "w", 1)
    got = sorted(((r["user"], r["src"][-5], r["time_ms"]) for r in s.read().collect()), key=str)
    assert got == sorted([("u", "c", 7), ("u", "b", 6), (None, "a", 1), (None, "b", 2)], key=str)


def test_stream_that_starts_again(spark, store, tmp_path):
    """A stream whose checkpoint was lost gives all batches again: the writer's numbers refuse them."""
    source = str(tmp_path / "in")
    for k in range(3):
        items(spark, f"s{k}", "same", kind=f"k{k}").coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(store.sink(T.first_seen, "stream")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run("one")
    want = held(store.read())
    assert len(want) == 4 and store.manifest().version == 3
    run("two")
    assert held(store.read()) == want and store.manifest().version == 3
