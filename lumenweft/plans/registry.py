"""The named queries of the engine and the SQL that states each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenweft.plans import activity, images, media, pages, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (pages, media, streams, activity, images):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
