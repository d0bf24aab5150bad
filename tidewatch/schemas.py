"""Column names and types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: The fields of a headerless knowledge-graph record, in order.
GKG_FIELDS = [
    "GKGRECORDID", "V2.1DATE", "V2SOURCECOLLECTIONIDENTIFIER", "V2SOURCECOMMONNAME", "V2DOCUMENTIDENTIFIER",
    "V1COUNTS", "V2.1COUNTS", "V1THEMES", "V2ENHANCEDTHEMES", "V1LOCATIONS", "V2ENHANCEDLOCATIONS",
    "V1PERSONS", "V2ENHANCEDPERSONS", "V1ORGANIZATIONS", "V2ENHANCEDORGANIZATIONS", "V1.5TONE",
    "V2.1ENHANCEDDATES", "V2GCAM", "V2.1SHARINGIMAGE", "V2.1RELATEDIMAGES", "V2.1SOCIALIMAGEEMBEDS",
    "V2.1SOCIALVIDEOEMBEDS", "V2.1QUOTATIONS", "V2.1ALLNAMES", "V2.1AMOUNTS", "V2.1TRANSLATIONINFO", "V2EXTRASXML",
]
PLACE_FIELDS = ["_source_file", "_file_ord", "_row_ord"]
RECORDS = T.StructType(
    [T.StructField(x, T.StringType()) for x in GKG_FIELDS]
    + [T.StructField("_source_file", T.StringType()), T.StructField("_file_ord", T.LongType()), T.StructField("_row_ord", T.LongType())]
)

#: The columns of the article, feature and anomaly tables, in order.
SILVER = (
    "source_file string, record_id string, article_id string, seen_at timestamp_ntz, canonical_url string, source_domain string, "
    "location_name string, country_code string, adm1_code string, adm2_code string, latitude double, longitude double, "
    "distinct_location_count long, location_selection_status string, location_candidate_regions array<string>, disaster_type string, "
    "disaster_match_strength string, matched_disaster_themes array<string>, themes array<string>, tone double, geo_confidence string, "
    "quality_flags array<string>, duplicate_group_id string, duplicate_group_method string, duplicate_group_size long"
)
SILVER_COLUMNS = [x.split()[0] for x in SILVER.split(", ")]

FEATURE_COLUMNS = [
    "window_start", "region_id", "country_code", "adm1_code", "disaster_type", "article_count", "high_confidence_article_count",
    "weak_article_count", "unique_domain_count", "estimated_unique_story_count", "high_confidence_story_count", "average_tone",
    "location_confident_article_count", "location_review_article_count", "duplicate_ratio", "previous_story_count",
    "previous_domain_count", "article_velocity", "domain_velocity",
]
KEY = ["window_start", "region_id", "disaster_type"]

ANOMALY = (
    "window_start timestamp_ntz, region_id string, country_code string, adm1_code string, disaster_type string, "
    "observed_feature_row boolean, article_count long, estimated_unique_story_count long, high_confidence_story_count long, "
    "unique_domain_count long, baseline_history_hours long, baseline_median double, baseline_mad double, robust_z_score double, "
    "anomaly_status string, is_candidate_anomaly boolean"
)

#: How a record's region was decided, and which decisions may be trusted.
CONFIDENT = ["single_region", "dominant_region", "legacy"]
REVIEW = ["missing", "ambiguous_region", "unresolved_region"]
UNKNOWN = "UNKNOWN"


def require(df, *names: str) -> None:
    """Raises ValueError if `df` lacks any of the columns."""
    missing = sorted(set(names).difference(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
