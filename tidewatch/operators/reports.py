"""Quality and feature reports, review samples, scorecards and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import iso, trimmed
from tidewatch.operators.features import distinct_with_null
from tidewatch.schemas import KEY, REVIEW, UNKNOWN, require

REVIEW_COLUMNS = [
    "article_id", "seen_at", "canonical_url", "source_domain", "disaster_type", "disaster_match_strength", "matched_disaster_themes", "location_name",
    "country_code", "adm1_code", "distinct_location_count", "location_selection_status", "location_candidate_regions", "quality_flags", "duplicate_group_size",
]
LABEL_COLUMNS = ["label_disaster_relevance", "label_primary_region", "review_notes"]
DISPLAYED = [
    *KEY, "article_count", "high_confidence_article_count", "weak_article_count", "unique_domain_count", "estimated_unique_story_count",
    "location_confident_article_count", "location_review_article_count", "duplicate_ratio", "article_velocity",
]
#: What a reviewer may say, and the order in which uncertain places are shown.
RELEVANCE = ["relevant", "not_relevant", "uncertain", ""]
DECISIONS = ["confirmed_event", "irrelevant_news", "uncertain"]
PRIORITY = ["ambiguous_region", "unresolved_region", "missing", "dominant_region", "single_region"]


def quality_totals(articles: DataFrame) -> DataFrame:
    has = lambda f: F.count_if(F.array_contains("quality_flags", f))
    return articles.agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("source_domain").alias("unique_domain_count"), F.countDistinct("country_code").alias("unique_country_count"),
        distinct_with_null("duplicate_group_id").alias("estimated_unique_story_count"), F.count_if(F.col("duplicate_group_size") > 1).alias("syndicated_article_count"),
        F.count_if(F.col("location_name").isNull()).alias("missing_location_count"), has("invalid_coordinates").alias("invalid_coordinate_count"),
        has("multiple_locations").alias("multiple_location_count"), has("ambiguous_region").alias("ambiguous_region_count"),
        F.count_if(F.col("location_selection_status").isin(REVIEW)).alias("location_review_count"),
    )


def status_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("location_selection_status").agg(F.count(F.lit(1)).alias("article_count")).orderBy("location_selection_status")


def top_locations(articles: DataFrame, n: int = 10) -> DataFrame:
    named = articles.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("location_name", "country_code")})
    counted = named.groupBy("location_name", "country_code").agg(F.count(F.lit(1)).alias("article_count"), distinct_with_null("source_domain").alias("unique_domain_count"))
    return counted.orderBy(F.desc("article_count"), F.desc("unique_domain_count"), "location_name", "country_code").limit(n)


def theme_counts(articles: DataFrame) -> DataFrame:
    """Articles per matching theme; an article without one counts under null."""
    rows = articles.select(F.explode_outer("matched_disaster_themes").alias("matched_disaster_themes"))
    return rows.groupBy("matched_disaster_themes").agg(F.count(F.lit(1)).alias("article_count")).orderBy(F.desc("article_count"), "matched_disaster_themes")


def top_story_groups(articles: DataFrame, n: int = 10) -> DataFrame:
    """Syndicated stories with the earliest article's URL, place and method."""
    first = F.min_by(
        F.struct(F.col("canonical_url").alias("example_url"), "location_name", F.col("duplicate_group_method").alias("method")),
        F.struct(F.col("seen_at").isNull(), "seen_at", "article_id"))
    rows = articles.where("duplicate_group_size > 1").groupBy("duplicate_group_id").agg(
        F.count(F.lit(1)).alias("article_count"), distinct_with_null("source_domain").alias("unique_domain_count"), first.alias("f"))
    return rows.select("duplicate_group_id", "article_count", "unique_domain_count", "f.*").orderBy(F.desc("article_count"), F.desc("unique_domain_count"), "duplicate_group_id").limit(n)


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def quality_report(articles: DataFrame, top: int = 10) -> dict:
    if "location_selection_status" not in articles.columns:
        articles = articles.withColumn("location_selection_status", F.lit(None).cast("string"))
        statuses = []
    else:
        statuses = _dicts(status_counts(articles))
    return _dicts(quality_totals(articles))[0] | {
        "location_selection_statuses": statuses, "top_locations": _dicts(top_locations(articles, top)),
        "matching_themes": _dicts(theme_counts(articles)), "top_story_groups": _dicts(top_story_groups(articles, top)),
    }


def top_signals(features: DataFrame, n: int = 10) -> DataFrame:
    order = [F.desc(c) for c in ("high_confidence_story_count", "unique_domain_count", "estimated_unique_story_count")]
    return features.orderBy(*order, *KEY).limit(n)


def rising(features: DataFrame, n: int = 10) -> DataFrame:
    return features.where("article_velocity > 0").orderBy(F.desc("article_velocity"), F.desc("unique_domain_count"), *KEY).limit(n)


def feature_report(features: DataFrame, top: int = 10) -> dict:
    s = features.agg(F.count(F.lit(1)).alias("feature_rows"), F.countDistinct("window_start").alias("hourly_windows"), F.countDistinct("region_id").alias("regions")).first()
    shown = lambda df: _dicts(df.select(*DISPLAYED).withColumn("window_start", iso("window_start")))
    return s.asDict() | {"top_signals": shown(top_signals(features, top)), "largest_positive_velocities": shown(rising(features, top))}


def review_bucket() -> Column:
    group = F.when(F.col("location_selection_status").isin(REVIEW), "needs_location_review").otherwise("assigned_location")
    return F.concat(F.coalesce("disaster_match_strength", F.lit("None")), F.lit(":"), group)


def location_priority() -> Column:
    return F.coalesce(F.nullif(F.array_position(F.lit(PRIORITY), F.col("location_selection_status")), F.lit(0)), F.lit(len(PRIORITY) + 1)) - 1


def review_sample(articles: DataFrame, size: int = 40) -> DataFrame:
    """A stratified sample: buckets in alphabetical order give one article each in turn, uncertain places first."""
    if size < 1:
        raise ValueError("size must be at least 1")
    require(articles, *REVIEW_COLUMNS)
    rows = articles.select(review_bucket().alias("review_bucket"), *REVIEW_COLUMNS)
    turn = F.row_number().over(W.partitionBy("review_bucket").orderBy(location_priority(), "article_id"))
    return rows.withColumn("_turn", turn).where(F.col("_turn") <= size).orderBy("_turn", "review_bucket").limit(size).drop("_turn")


def review_csv(sample: DataFrame) -> DataFrame:
    """The sample as text columns, with empty columns for labels."""
    lists = {c: F.to_json(F.coalesce(c, F.array().cast("array<string>"))) for c in ("matched_disaster_themes", "location_candidate_regions", "quality_flags")}
    return sample.withColumns(lists | {"seen_at": F.coalesce(F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss"), F.lit(""))} | {c: F.lit("") for c in LABEL_COLUMNS})


def machine_region() -> Column:
    part = lambda c: F.nullif(F.upper(trimmed(c)), F.lit(""))
    sure = F.col("location_selection_status").isin("single_region", "dominant_region")
    country, adm1 = part("country_code"), part("adm1_code")
    return F.when(sure, F.coalesce(F.when(adm1.isNotNull(), F.concat(country, F.lit(":"), adm1)), country, F.lit(UNKNOWN))).otherwise(UNKNOWN)


def scorecard(reviews: DataFrame) -> dict:
    """Shares of relevant articles by strength, and accuracy of regions, from a labelled review sheet."""
    need = ["disaster_match_strength", "location_selection_status", "country_code", "adm1_code", *LABEL_COLUMNS[:2]]
    require(reviews, *need)
    rows = reviews.na.fill("", need).select(
        (F.monotonically_increasing_id() + 2).alias("row"), F.lower(trimmed("label_disaster_relevance")).alias("said"), F.upper(trimmed("label_primary_region")).alias("region"),
        F.lower(trimmed("disaster_match_strength")).alias("strength"), machine_region().alias("machine"))
    wrong = rows.where(~F.col("said").isin(RELEVANCE)).orderBy("row").limit(1).collect()
    if wrong:  # a sheet is one file with a header, so its first row is row 2
        raise ValueError(f"row {wrong[0].row}: unsupported relevance label {wrong[0].said!r}")
    told, sure = F.col("said").isin("relevant", "not_relevant"), ~F.col("region").isin("", "UNCERTAIN")
    relevant = F.count_if(F.col("said") == "relevant").alias("relevant")
    a = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(told).alias("labeled"), F.count_if(F.col("said") == "").alias("unlabeled"), F.count_if(F.col("said") == "uncertain").alias("uncertain"), relevant,
        F.count_if(sure).alias("r_labeled"), F.count_if(F.col("region") == "").alias("r_unlabeled"), F.count_if(F.col("region") == "UNCERTAIN").alias("r_uncertain"),
        F.count_if(sure & (F.col("region") == F.col("machine"))).alias("correct")).first()
    share = lambda x, y: x / y if y else None
    by = {r.strength: {"labeled": r.labeled, "relevant": r.relevant, "relevance_rate": share(r.relevant, r.labeled)}
          for r in rows.where(told).groupBy("strength").agg(F.count(F.lit(1)).alias("labeled"), relevant).orderBy("strength").collect()}
    return {
        "review_rows": a.n,
        "relevance": {"labeled_rows": a.labeled, "unlabeled_rows": a.unlabeled, "uncertain_rows": a.uncertain, "relevant_rows": a.relevant, "overall_relevance_rate": share(a.relevant, a.labeled), "by_match_strength": by},
        "primary_region": {"labeled_rows": a.r_labeled, "unlabeled_rows": a.r_unlabeled, "uncertain_rows": a.r_uncertain, "correct_rows": a.correct, "accuracy": share(a.correct, a.r_labeled)},
    }


def latest_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_rn", last).where("_rn = 1").drop("_rn")


def valid_review() -> Column:
    """Whether region_code, window_start and decision make a review that may be stored."""
    times = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX"]
    timed = F.coalesce(*(F.try_to_timestamp("window_start", F.lit(t)) for t in times)).isNotNull()
    return F.coalesce(F.col("region_code").rlike("^[A-Za-z0-9:_-]{1,64}$") & F.length("window_start").between(19, 40) & timed & F.col("decision").isin(DECISIONS), F.lit(False))


def signal_id(region: str = "region_code", window: str = "window_start") -> Column:
    return F.concat_ws("|", region, window)


def reviewed_signals(signals: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidate signals with their latest decision, null where there is none."""
    found = signals.where("status = 'candidate_anomaly'").withColumn("signal_id", signal_id("code", "window_start"))
    return found.join(reviews.select("signal_id", "decision"), "signal_id", "left")


