"""The Spark session that tests, bench and command line share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", partitions: int = 8, **extra: str) -> SparkSession:
    """UTC, zstd Parquet and a small number of shuffle partitions; `extra` adds or overrides settings.

    On a cluster the caller's own session is used as it is; nothing in this
    package sets session-wide options.
    """
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.driver.memory": "6g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    spark = SparkSession.builder.master(master).appName("tidewatch").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
