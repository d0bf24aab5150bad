"""Parquet tables replaced as a whole, JSON review logs, and CSV sheets."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.features import merge_history, merge_stats
from tidewatch.operators.reports import latest_by, signal_id, valid_review

REVIEW_LOG = "signal_id string, region_code string, window_start string, decision string, reviewed_at string"
LOG_BYTES = 4 << 20


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, None if there is none. What `replace_table` had moved away when it was cut off comes back first."""
    fs, target = _filesystem(spark, path)
    if not fs.exists(target):
        left = [x.getPath() for x in fs.globStatus(target.suffix(".*.old")) or []]
        if not left:
            return None
        if not fs.rename(left[0], target):
            raise OSError(f"{path} can't be moved back")
    return spark.read.parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside `path` and renames, so the table being replaced can be read by `df` itself. Works on any Hadoop file system.

    Between the two renames there is no table at `path`; `existing` mends that.
    """
    spark = df.sparkSession
    fs, target = _filesystem(spark, path)
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    staged, old = (new_path(f"{path.rstrip('/')}.{uuid.uuid4().hex}.{kind}") for kind in ("partial", "old"))
    try:
        df.write.option("compression", "zstd").parquet(staged.toString())
        if fs.exists(target) and not fs.rename(target, old):
            raise OSError(f"{path} can't be moved away")
        if not fs.rename(staged, target):
            fs.rename(old, target)
            raise OSError(f"{path} can't be replaced")
    finally:
        for p in (staged, old):
            if fs.exists(p) and (p is staged or fs.exists(target)):
                fs.delete(p, True)


def update_history(spark: SparkSession, batch: DataFrame, path: str) -> dict[str, int]:
    """Merges a batch of features into the history table at `path`."""
    history = existing(spark, path)
    merged = merge_history(history, batch)
    stats = merge_stats(history, batch, merged)
    replace_table(merged.orderBy("window_start", "region_id", "disaster_type"), path)
    return stats


def read_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV sheet with a header, all text; absent columns are an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = sorted(set(columns) - set(raw.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return raw.select([F.col(f"`{c}`").cast("string") for c in raw.columns]).na.fill("")


def write_sheet(df: DataFrame, path: str) -> None:
    """One CSV file with a header in the folder `path`; for small results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _log_bytes(spark: SparkSession, path: str) -> int:
    fs, target = _filesystem(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def save_reviews(reviews: DataFrame, path: str, now: datetime | None = None) -> int:
    """Appends valid (region_code, window_start, decision) rows to the log; an invalid row, or a log of LOG_BYTES, is an error and nothing is written."""
    if reviews.where(~valid_review()).limit(1).count():
        raise ValueError("a review has an unsupported region, window or decision")
    if _log_bytes(reviews.sparkSession, path) >= LOG_BYTES:
        raise ValueError("the review log is full")
    at = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    reviews.select(signal_id().alias("signal_id"), "region_code", "window_start", "decision", F.lit(at).alias("reviewed_at")).write.mode("append").json(path)
    return reviews.count()


def save_review(path: str, region_code: str, window_start: str, decision: str, spark: SparkSession) -> int:
    return save_reviews(spark.createDataFrame([(region_code, window_start, decision)], "region_code string, window_start string, decision string"), path)


def latest_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The last line on each signal, newest first. A broken line is an error, and so is a log of more than LOG_BYTES.

    Lines come in the order of the appends, and within one as they stand in its files.
    """
    if _log_bytes(spark, path) > LOG_BYTES:
        raise ValueError("the review log is too large")
    log = spark.read.schema(T._parse_datatype_string(REVIEW_LOG)).option("mode", "FAILFAST").json(path)
    lines = log.select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    several = F.when(F.col("_files") > 1, F.col("reviewed_at"))  # appends that a clock can't tell apart; one file is read as it stands
    lines = lines.withColumn("_files", F.size(F.collect_set("_file").over(W.partitionBy("signal_id")))).withColumn("_told", several)
    return latest_by(lines, "signal_id", "_at", "_told", "_file", "_line").select(*log.columns).orderBy(F.desc("reviewed_at"), "signal_id")


def append_manifest(path: str, entry: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")


def remove(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)
