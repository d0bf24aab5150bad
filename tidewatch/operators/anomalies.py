"""Zero-filled hourly series against a rolling median/MAD baseline."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.schemas import ANOMALY, KEY, require

#: Consistency factor of the MAD, and the default gate.
MAD_SCALE = 1.4826
DEFAULTS = {"lookback_hours": 720, "minimum_history_hours": 168, "z_threshold": 6.0, "minimum_stories": 3, "minimum_domains": 3, "minimum_story_increase": 3}
COUNTS = ["article_count", "estimated_unique_story_count", "high_confidence_story_count", "unique_domain_count"]
BASELINE = "window_start timestamp_ntz, region_id string, disaster_type string, baseline_history_hours long, baseline_median double, baseline_mad double"


def densified(features: DataFrame) -> DataFrame:
    """A row for every series and hour between the first and the last hour of all; hours without a row count 0.

    Each row fills the gap up to its series' next one, the first also the one
    before it: one window over the rows, dealt as the baselines are.
    """
    ends = features.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b")).first()
    series = W.partitionBy("region_id", "disaster_type")
    in_turn, hour = series.orderBy("window_start"), F.expr("INTERVAL 1 HOUR")
    rows = features.select(
        *KEY, *COUNTS, *(F.max(c).over(series).alias(c) for c in ("country_code", "adm1_code")),
        F.lag("window_start").over(in_turn).alias("_before"), F.lead("window_start").over(in_turn).alias("_after"))
    first = F.when(F.col("_before").isNull(), F.lit(ends.a).cast("timestamp_ntz")).otherwise(F.col("window_start"))
    last = F.greatest("window_start", F.coalesce(F.col("_after") - hour, F.lit(ends.b).cast("timestamp_ntz")))
    filled = rows.select("*", F.explode(F.sequence(first, last, hour)).alias("_hour")).withColumn("observed_feature_row", F.col("_hour") == F.col("window_start"))
    counts = (F.when(F.col("observed_feature_row"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in COUNTS)
    return filled.select(F.col("_hour").alias("window_start"), *KEY[1:], "country_code", "adm1_code", *counts, "observed_feature_row")


def rolling_baseline(values: np.ndarray, lookback: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, median and median absolute deviation of up to `lookback` values before each; NaN below `least`."""
    n = len(values)
    count = np.minimum(np.arange(n), lookback)
    median, mad = np.full(n, np.nan), np.full(n, np.nan)
    window: list = []
    for t in range(n):
        if t:
            insort(window, values[t - 1])
            if t > lookback:
                del window[bisect_left(window, values[t - 1 - lookback])]
        if count[t] >= least:
            k = len(window)
            m = (window[(k - 1) // 2] + window[k // 2]) / 2
            d = np.abs(np.array(window) - m)
            d.partition([(k - 1) // 2, k // 2])
            median[t], mad[t] = m, (d[(k - 1) // 2] + d[k // 2]) / 2
    return count, median, mad


def _series(lookback: int, least: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window_start")
        count, median, mad = rolling_baseline(pdf["high_confidence_story_count"].tolist(), lookback, least)
        return pd.DataFrame({"window_start": pdf["window_start"], "region_id": pdf["region_id"], "disaster_type": pdf["disaster_type"], "baseline_history_hours": count, "baseline_median": median, "baseline_mad": mad})

    return of


def native_baseline(dense: DataFrame, lookback: int, least: int) -> DataFrame:
    """The same baseline as window expressions; better for short lookbacks."""
    w = W.partitionBy("region_id", "disaster_type").orderBy("window_start").rowsBetween(-lookback, -1)
    x = "high_confidence_story_count"
    rows = dense.select(*KEY, F.count(F.lit(1)).over(w).alias("baseline_history_hours"), F.percentile(x, 0.5).over(w).alias("m"), F.collect_list(x).over(w).alias("h"))
    d = F.array_sort(F.transform("h", lambda v: F.abs(v - F.col("m"))))
    half = lambda k: F.get(d, F.floor((F.size("h") - k) / 2).cast("int"))
    enough = F.col("baseline_history_hours") >= least
    return rows.select(*KEY, "baseline_history_hours", F.when(enough, F.col("m")).alias("baseline_median"), F.when(enough, (half(1) + half(0)) / 2).alias("baseline_mad"))


def robust_z() -> Column:
    return F.when(F.col("baseline_mad") > 0, (F.col("high_confidence_story_count") - F.col("baseline_median")) / (MAD_SCALE * F.col("baseline_mad")))


def status_of(p: dict) -> Column:
    signal = F.col("high_confidence_story_count")
    return (
        F.when(F.col("baseline_history_hours") < p["minimum_history_hours"], "insufficient_history")
        .when((signal < p["minimum_stories"]) | (F.col("unique_domain_count") < p["minimum_domains"]), "below_minimum_support")
        .when(F.col("baseline_median").isNull() | (signal - F.col("baseline_median") < p["minimum_story_increase"]), "normal")
        .when(F.col("baseline_mad") == 0, "candidate_anomaly")
        .when(F.col("robust_z_score") >= p["z_threshold"], "candidate_anomaly")
        .otherwise("normal")
    )


def checked(parameters: dict) -> dict:
    p = DEFAULTS | parameters
    if p["minimum_history_hours"] < 1:
        raise ValueError("minimum_history_hours must be at least 1")
    if p["lookback_hours"] < p["minimum_history_hours"]:
        raise ValueError("lookback_hours must be at least minimum_history_hours")
    if p["z_threshold"] <= 0 or min(p["minimum_stories"], p["minimum_domains"], p["minimum_story_increase"]) < 1:
        raise ValueError("thresholds must be positive")
    return p


def check_series(features: DataFrame) -> None:
    """Raises ValueError if an hour of a series is there twice, or a series changes its codes."""
    kinds = lambda c: F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))
    bad = features.groupBy("region_id", "disaster_type").agg(
        (F.count(F.lit(1)) > F.countDistinct("window_start")).alias("twice"), ((kinds("country_code") > 1) | (kinds("adm1_code") > 1)).alias("mixed"))
    row = bad.agg(F.max("twice").alias("twice"), F.max("mixed").alias("mixed")).first()
    if row.twice:
        raise ValueError("an hour of a region and hazard is there more than once")
    if row.mixed:
        raise ValueError("a region's codes change within its series")


def score(features: DataFrame, check: bool = True, **parameters) -> DataFrame:
    """The 16-column anomaly table: every series at every hour, judged against the hours before.

    A task holds one series at a time, as many rows as the table has hours.
    """
    p = checked(parameters)
    require(features, *KEY, "country_code", "adm1_code", *COUNTS)
    if check:
        check_series(features)
    dense = densified(features)
    if p["lookback_hours"] <= 48:
        base = native_baseline(dense, p["lookback_hours"], p["minimum_history_hours"])
    else:
        base = dense.select(*KEY, "high_confidence_story_count").groupBy("region_id", "disaster_type").applyInPandas(_series(p["lookback_hours"], p["minimum_history_hours"]), BASELINE)
        base = base.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("baseline_median", "baseline_mad")})
    out = dense.join(base, KEY).withColumn("robust_z_score", robust_z()).withColumn("anomaly_status", status_of(p))
    out = out.withColumn("is_candidate_anomaly", F.col("anomaly_status") == "candidate_anomaly")
    return out.select(*(x.split()[0] for x in ANOMALY.split(", ")))


def status_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("anomaly_status").agg(F.count(F.lit(1)).alias("row_count")).orderBy("anomaly_status")


def top_candidates(scored: DataFrame, n: int = 20) -> DataFrame:
    order = [F.desc_nulls_last(c) for c in ("robust_z_score", "high_confidence_story_count", "unique_domain_count")]
    return scored.where("is_candidate_anomaly").orderBy(*order, *KEY).limit(n).select(
        *KEY, "high_confidence_story_count", "unique_domain_count", "baseline_median", "baseline_mad", "robust_z_score")


def anomaly_stats(features: DataFrame, scored: DataFrame) -> dict[str, int]:
    s = scored.agg(
        F.count(F.lit(1)).alias("scored_rows"), F.count_if("observed_feature_row").alias("observed_feature_rows"), F.countDistinct("window_start").alias("hourly_windows"),
        F.countDistinct("region_id").alias("regions"), F.count_if("is_candidate_anomaly").alias("candidate_anomalies"),
        F.count_if(F.col("anomaly_status") == "insufficient_history").alias("insufficient_history_rows")).first()
    return {"input_feature_rows": features.count()} | s.asDict()
