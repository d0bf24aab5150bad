"""Clean article records: theme filter, identity, exact and syndication duplicates, places, quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import locations, text, urls
from tidewatch.schemas import REVIEW, SILVER_COLUMNS


def classified(records: DataFrame, hazard: str = "flood") -> DataFrame:
    """Records with their themes, the matching ones, and the strength of the match (null: none)."""
    if hazard not in text.HAZARDS:
        raise ValueError(f"unknown hazard {hazard}; known: {sorted(text.HAZARDS)}")
    themes = text.theme_tokens(F.col("V1THEMES"), F.col("V2ENHANCEDTHEMES"))
    out = records.withColumn("themes", themes).withColumn("matched", text.matched_themes("themes", hazard))
    return out.withColumn("strength", text.match_strength(F.col("matched"), hazard))


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def silver(records: DataFrame, hazard: str = "flood", strength: str = "high") -> DataFrame:
    """The 25-column article table.

    The theme filter comes before the URL function, and duplicates go before
    places are parsed: both only see the few rows that are left.
    """
    if strength not in text.STRENGTHS:
        raise ValueError(f"unknown strength {strength}; known: {sorted(text.STRENGTHS)}")
    rows = classified(records, hazard).where(text.strength_rank(F.col("strength")) >= text.STRENGTHS[strength])
    raw = text.trimmed(F.coalesce("V2DOCUMENTIDENTIFIER", F.lit("")))
    rows = rows.withColumn("_raw", raw).withColumn("u", urls.url_identity("_raw"))
    rows = rows.withColumn("article_id", urls.article_id(F.col("u.canonical_url"), F.col("_raw")))
    rows = first_wins(rows, "article_id", "_file_ord", "_row_ord")

    rows = rows.withColumn("places", locations.parse_locations("V2ENHANCEDLOCATIONS"))
    rows = rows.withColumn("ranked", locations.ranked_regions(F.col("places")))
    rows = rows.withColumn("status", locations.selection_status(F.col("places"), F.col("ranked")))
    rows = rows.withColumn("p", locations.primary_place(F.col("places"), F.col("status"), F.col("ranked")))
    rows = rows.withColumn("seen_at", text.record_time("`V2.1DATE`")).withColumn("distinct_location_count", locations.distinct_places(F.col("places")).cast("long"))
    rows = rows.withColumn("group", urls.story_group(F.col("u.slug"), text.six_hours_of("seen_at"), F.lit(hazard), F.col("article_id")))
    flags = text.flags(
        ("invalid_url", F.col("u.canonical_url").isNull()), ("invalid_seen_at", F.col("seen_at").isNull()),
        ("missing_location", F.col("p").isNull()), ("invalid_coordinates", ~F.col("p.valid")),
        ("multiple_locations", F.col("distinct_location_count") > 1),
        ("ambiguous_region", F.col("status") == "ambiguous_region"), ("unresolved_region", F.col("status") == "unresolved_region"),
    )
    out = rows.select(
        F.col("_source_file").alias("source_file"), F.coalesce(F.nullif("GKGRECORDID", F.lit("")), "article_id").alias("record_id"), "article_id", "seen_at",
        F.col("u.canonical_url").alias("canonical_url"), F.coalesce(F.nullif("u.source_domain", F.lit("")), F.nullif("V2SOURCECOMMONNAME", F.lit(""))).alias("source_domain"),
        F.col("p.name").alias("location_name"), F.col("p.country").alias("country_code"), F.col("p.adm1").alias("adm1_code"), F.col("p.adm2").alias("adm2_code"),
        F.col("p.lat").alias("latitude"), F.col("p.lon").alias("longitude"), "distinct_location_count",
        F.col("status").alias("location_selection_status"), F.col("ranked.region").alias("location_candidate_regions"), F.lit(hazard).alias("disaster_type"),
        F.col("strength").alias("disaster_match_strength"), F.col("matched").alias("matched_disaster_themes"), "themes",
        text.number(text.before_comma("`V1.5TONE`")).alias("tone"),
        F.when(F.col("p").isNull(), "missing").when(F.col("p.valid"), "coordinates_valid").otherwise("location_only").alias("geo_confidence"),
        flags.alias("quality_flags"), F.col("group.id").alias("duplicate_group_id"), F.col("group.method").alias("duplicate_group_method"),
    )
    size = F.count(F.lit(1)).over(W.partitionBy("duplicate_group_id"))
    return out.withColumn("duplicate_group_size", size).select(*SILVER_COLUMNS)


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("seen_at"), "article_id")


def counters(records: DataFrame, cleaned: DataFrame, n_files: int, hazard: str = "flood", strength: str = "high") -> dict[str, int]:
    """The run's counts before and after the filters and after deduplication."""
    ranks = classified(records, hazard).select(text.strength_rank(F.col("strength")).alias("r"))
    low = text.STRENGTHS[strength]
    before = ranks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") > 0).alias("m"), F.count_if(F.col("r").between(1, low - 1)).alias("w"), F.count_if(F.col("r") >= low).alias("d")).first()
    status = F.col("location_selection_status")
    after = cleaned.agg(F.count(F.lit(1)).alias("n"), F.count_if(status.isin(REVIEW)).alias("r"), F.count_if(status == "ambiguous_region").alias("a")).first()
    return {
        "input_files": n_files, "input_rows": before.n, "theme_matched_rows": before.m, "weak_rows_skipped": before.w, "disaster_rows": before.d,
        "duplicate_rows": before.d - after.n, "location_review_rows": after.r, "ambiguous_region_rows": after.a, "output_rows": after.n,
    }
