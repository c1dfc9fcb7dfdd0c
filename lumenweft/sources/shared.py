"""Tables in the folder that driver and executors share; used to cut the lineage of iterations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SHARED = "/tmp/checkpoints"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir of the session. On a local master a local folder stands in where it names none; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or DEFAULT_SHARED).rstrip('/')}/lumenweft-core/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once below the shared folder and read again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
