"""Bounded stores: against a walk over the puts, as streams, and what is left after expiry."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenweft.operators import bounded

PUT = "store_id string, seq bigint, key string, value string, generation bigint, ts timestamp, place string"
START = datetime(2024, 1, 1)


def puts(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for k in range(n):
        key = None if r.random() < 0.02 else f"k{r.randint(0, 30)}"
        out.append((r.choice(["a", "b", None]), k, key, r.choice([None, "v", f"v{k}"]), r.choice([None, k // 20, k // 20, k // 20 - 1]), START + timedelta(seconds=k), "clash"))
    return out


def walked(rows, cap, moves):
    stores, newest = {}, {}
    for s, _, key, value, gen, *_ in rows:
        held = stores.setdefault(s, {})
        if key is not None and gen is not None and gen < newest.get(s, gen):
            continue
        newest[s] = max(gen, newest.get(s, gen)) if gen is not None else newest.get(s, -9)
        if key is None:
            held.clear()
            continue
        if moves:
            held.pop(key, None)
        if key not in held and len(held) >= cap:
            del held[next(iter(held))]
        held[key] = value
    return sorted(((s, i + 1, k, v) for s, held in stores.items() for i, (k, v) in enumerate(held.items())), key=str)


def listed(df):
    return sorted(((r["store_id"], r["place"], r["key"], r["value"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("cap", [1, 7, 100])
def test_against_a_walk(spark, cap):
    rows = puts(600)
    df = spark.createDataFrame(rows, PUT).repartition(5)
    assert listed(bounded.first_in(df, cap)) == walked(rows, cap, False)
    assert listed(bounded.most_recent(df, cap)) == walked(rows, cap, True)
    assert bounded.first_in(df.where("false")).count() == bounded.most_recent(df.where("false")).count() == 0


@pytest.mark.parametrize("moves", [False, True])
def test_stream_equals_batch_and_expires(spark, tmp_path, moves):
    from lumenweft.streaming import bounded as stream

    rows = [p for p in puts(240, 4) if p[0] is not None]
    make = stream.most_recent_stream if moves else stream.first_in_stream
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    source = spark.readStream.schema(PUT).option("maxFilesPerTrigger", 1).parquet(folder) if (tmp_path / "in").mkdir() is None else None
    with pytest.raises(ValueError):
        make(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.PROVIDER)
    try:
        changes = make(source.withWatermark("ts", "1 second"), 7, 60_000)

        def run() -> None:  # a restart: state and progress come from the checkpoint
            q = changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).start()
            q.processAllAvailable()
            q.stop()

        for k in range(2):
            spark.createDataFrame(rows[k * 120 : (k + 1) * 120], PUT).coalesce(1).write.mode("append").parquet(folder)
            run()
        got = spark.read.parquet(out)
        assert listed(stream.contents(got.unionByName(got))) == walked(rows, 7, moves)
        late = [("c", 10_000, "z", "v", None, START + timedelta(hours=2), ""), ("c", 10_001, "y", "v", None, START + timedelta(hours=2), "")]
        for row in late:  # the second batch moves the watermark beyond the timers of a and b
            spark.createDataFrame([row], PUT).coalesce(1).write.mode("append").parquet(folder)
            run()
        assert listed(stream.contents(spark.read.parquet(out))) == [("c", 1, "z", "v"), ("c", 2, "y", "v")]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
