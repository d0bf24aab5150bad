"""Incremental refresh: new record files, recomputed hours, merged history, new scores.

A micro-batch holds new files only, so its clean records are appended to a
silver table first, but for articles that earlier batches hold (a table of ids
tells), and every hour they touch is recomputed from that hour's folders; a
late file thus never replaces a whole hour by a part of it. A batch that is
run again after a failure appends under its own batch number, which is
overwritten, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import anomalies, features, silver
from tidewatch.sources import gkg, tables


def refresh_batch(silver_path: str, history_path: str, hazard: str, strength: str, after: Callable | None = None) -> Callable:
    """The function for foreachBatch."""

    def of(records: DataFrame, batch: int) -> None:
        spark = records.sparkSession
        found = silver.silver(records, hazard, strength).withColumn("hour", F.date_format("seen_at", "'h'yyyyMMddHH"))
        # A batch may come again after it was cut off: what it wrote itself counts for nothing.
        seen = tables.existing(spark, f"{silver_path}_ids")
        if seen is not None:
            found = found.join(seen.where(F.col("batch") != batch).select("article_id"), "article_id", "left_anti")
        mine = f"{silver_path}/batch={batch}"
        found.write.mode("overwrite").option("compression", "zstd").partitionBy("hour").parquet(mine)
        hours = [r.hour for r in spark.read.schema(found.schema).parquet(mine).where("hour is not null").select("hour").distinct().collect()]  # as many as a batch's files have hours
        if hours:
            # Only these hours' folders are read, in all batches; their articles differ already.
            every = spark.read.schema(found.schema.add("batch", "long")).option("basePath", silver_path).parquet(silver_path)
            tables.update_history(spark, features.build_features(every.where(F.col("hour").isin(hours)).drop("batch", "hour")), history_path)
        spark.read.schema(found.schema).parquet(mine).select("article_id").write.mode("overwrite").parquet(f"{silver_path}_ids/batch={batch}")
        if hours and after:
            after(spark, batch)

    return of


def run_refresh(spark: SparkSession, folder: str, state: str, hazard: str = "flood", strength: str = "high", pattern: str = f"*{'.gkg.csv.zip'}", scores: bool = True, **parameters) -> DataFrame:
    """Processes the files that are new since the last run, then scores the history. Returns the history.

    state holds the checkpoint, the silver and history tables and the scores.
    """
    gkg.register(spark)
    stream = spark.readStream.format("gkg").option("path", folder).option("glob", pattern).load()
    work = refresh_batch(f"{state}/silver", f"{state}/history", hazard, strength)
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    history = tables.existing(spark, f"{state}/history")
    if scores:
        tables.replace_table(anomalies.score(history, **parameters), f"{state}/scores")
    return history


def streaming_hourly_counts(articles: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Hourly counts of a stream, late rows accepted for `delay`; watermarks need a timestamp with time zone."""
    rows = articles.withColumn("_at", F.col("seen_at").cast("timestamp")).withWatermark("_at", delay)
    return rows.groupBy(F.window("_at", "1 hour").alias("w"), "disaster_type").agg(F.count(F.lit(1)).alias("article_count")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "disaster_type", "article_count")


def streaming_dedup(articles: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Exact duplicates dropped within the watermark."""
    rows = articles.withColumn("_at", F.col("seen_at").cast("timestamp")).withWatermark("_at", delay)
    return rows.dropDuplicatesWithinWatermark(["article_id"]).drop("_at")
