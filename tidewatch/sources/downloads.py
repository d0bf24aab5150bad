"""Fetching raw files: the newest URL of an index, windows of 15 minutes, checked downloads, retention.

These run on the driver, beside Spark; a streaming checkpoint decides what is
new for Spark itself.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tables import append_manifest

#: The suffix of record files, their spacing, and the bounds of a window and of its workers.
SUFFIX = ".gkg.csv.zip"
SPACING = timedelta(minutes=15)
MOST_FILES, MOST_WORKERS = 672, 16


def latest_url(index: str) -> str:
    """The URL in the first line of an index whose last field names a record file."""
    for line in index.splitlines():
        fields = line.split()
        if fields and fields[-1].endswith(SUFFIX):
            return fields[-1]
    raise ValueError("the index names no record file")


def window_urls(latest: str, n: int) -> list[str]:
    """`n` URLs 15 minutes apart, oldest first, the last one `latest`."""
    if not 1 <= n <= MOST_FILES:
        raise ValueError(f"n must be from 1 to {MOST_FILES}")
    m = re.fullmatch(rf"(.*/)?(\d{{14}}){re.escape(SUFFIX)}", latest)
    if not m:
        raise ValueError(f"not a record file: {latest}")
    end = datetime.strptime(m[2], "%Y%m%d%H%M%S")
    return [f"{m[1] or ''}{end - k * SPACING:%Y%m%d%H%M%S}{SUFFIX}" for k in reversed(range(n))]


def window_stamps(ends: DataFrame, end: str, n: int) -> DataFrame:
    """The same timestamps as rows, for each row's `end`."""
    times = F.sequence(F.col(end) - F.expr(f"INTERVAL {15 * (n - 1)} MINUTE"), F.col(end), F.expr("INTERVAL 15 MINUTE"))
    return ends.select(F.explode(F.transform(times, lambda t: F.date_format(t, "yyyyMMddHHmmss"))).alias("stamp"))


def sha256_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files that Spark can read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def download(url: str, folder: str, timeout: float = 120, fetch: Callable = urlopen) -> dict:
    """Fetches a file unless it is there; a partial file never gets the final name."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, url.rsplit("/", 1)[-1])
    status = "already_present"
    if not os.path.exists(path):
        status = "downloaded"
        handle, partial = tempfile.mkstemp(dir=folder, suffix=".partial")
        try:
            with os.fdopen(handle, "wb") as out, fetch(url, timeout=timeout) as response:
                while block := response.read(1 << 20):
                    out.write(block)
            os.replace(partial, path)
        finally:
            if os.path.exists(partial):
                os.unlink(partial)
    return {"source_url": url, "local_path": path, "sha256": sha256_of(path), "bytes": os.path.getsize(path), "status": status, "retrieved_at": datetime.now(UTC).isoformat()}


def download_window(urls: list[str], folder: str, manifest: str | None = None, workers: int = 8, timeout: float = 120, fetch: Callable = urlopen) -> dict[str, int]:
    """Fetches files in parallel; the first error stops what hasn't begun. New files are noted in the manifest."""
    if not 1 <= workers <= MOST_WORKERS:
        raise ValueError(f"workers must be from 1 to {MOST_WORKERS}")
    stats = {"files": len(urls), "downloaded": 0, "already_present": 0, "bytes": 0}
    with ThreadPoolExecutor(workers) as pool:
        try:
            for entry in pool.map(lambda u: download(u, folder, timeout, fetch), urls):
                stats[entry["status"]] += 1
                stats["bytes"] += entry["bytes"]
                if entry["status"] == "downloaded":
                    append_manifest(manifest or os.path.join(folder, "manifest.jsonl"), entry)
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise
    return stats


def prune(folder: str, keep: int = MOST_FILES) -> list[str]:
    """Removes all but the newest record files, by name; to be called after a successful run."""
    names = sorted(x for x in os.listdir(folder) if x.endswith(SUFFIX))
    gone = names[: max(0, len(names) - keep)]
    for x in gone:
        os.unlink(os.path.join(folder, x))
    return gone
