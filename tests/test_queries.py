"""Every registered query of the engine: against its SQL, or that it runs and repeats itself."""

import pytest

from lumenweft.plans import registry
from tests.compare import rows, same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    same(spark, sf, name, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_repeats(spark, sf, name):
    q = registry.QUERIES[name]
    first = q(spark, sf).toPandas()
    assert len(first) and rows(first) == rows(q(spark, sf).toPandas())


def test_page_signals_whole(spark, sf):
    got = registry.QUERIES["page_signals_whole"](spark, sf).toPandas()
    assert len(got) == 100
    assert got.image_count.sum() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_production_limits(spark, sf, tmp_path):
    links = registry.QUERIES["gallery_page_gate_whole"](spark, sf).groupBy("page_id").count().toPandas()["count"]
    assert 3 < links.max() <= 60
    assert 100 < registry.QUERIES["merge_history_whole"](spark, sf).count() <= 500
    spark.range(12_000).selectExpr("id as event_id", "0L as user_id").write.parquet(f"{tmp_path}/events.parquet")
    assert registry.QUERIES["deep_scan_rounds"](spark, str(tmp_path)).first()["found"] == 400
