"""Session defaults shared by the tests, the bench and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", app: str = "lumenweft") -> SparkSession:
    """A local session with the settings that a cluster would also have (AQE, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
