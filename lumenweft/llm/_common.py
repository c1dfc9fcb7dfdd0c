"""What the operators of this subpackage share: tables in the shared folder, batches, inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the session names none a local folder stands in, on a local master only; on a cluster this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or DEFAULT_SHARED


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lumenweft/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read again; this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches that Python workers hold: texts may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


#: What operators remember in a worker between tasks; each is a dict that may be cleared at any time between tasks.
REMEMBERED: list[dict] = []


def release(forget: bool = False) -> None:
    """Gives a worker's free memory back to the system, and with forget what other operators remember in it.

    Spark uses workers again; without this, one stage's memory stays while the next stages run.
    """
    import ctypes

    import pyarrow as pa

    if forget:
        for memo in REMEMBERED:
            memo.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text); a null text is empty. Other columns, whatever their names, go."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


#: Up to so many ids a filter by doc_id is broadcast (8 bytes each); beyond, it is a shuffled join.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the rows whose doc_id is in ids (doc_id, no nulls). Rows without a doc_id stay."""
    ids = stored(ids.distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


def sized(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A stored table of some whole numbers a row, to be broadcast in a join if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


#: Parts that the rows of one key are dealt into before they meet the key's values.
SALTS = 256


def spread_join(rows: DataFrame, values: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """rows joined with values (one row a key), the rows of a key being dealt into SALTS parts by the columns `by`.

    A key's value is copied only to the parts that the key's rows are in, so a key that holds a third of all rows makes
    SALTS groups, and a key of one row one. rows must give the same values each time they are read.
    """
    salt = "_salt"
    while salt in rows.columns:
        salt += "_"
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*by, F.lit(5)), F.lit(SALTS)).cast("int"))
    placed = salted.select(*key, salt).distinct().join(values, key)
    return salted.join(placed, [*key, salt]).drop(salt)
