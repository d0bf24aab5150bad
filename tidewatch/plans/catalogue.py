"""Queries over the driver's tables, each with its DuckDB counterpart.

The engine works on news articles; here they are views of the given tables:
events become articles, runs of line items become location strings, part types
become themes, pages give URLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import locations, text, urls
from tidewatch.operators import anomalies, evidence, features, reports, silver
from tidewatch.sources import downloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as articles."""
    e = table(spark, sf_dir, "events")
    r = F.col("user_id") % 20
    known = r > 0
    return e.select(
        F.col("event_id").cast("string").alias("article_id"), F.col("ts").alias("seen_at"), F.col("event_type").alias("disaster_type"),
        F.when(known, F.concat(F.lit("C"), r % 4)).alias("country_code"), F.when(known, F.concat(F.lit("A"), r)).alias("adm1_code"),
        F.when(known, F.when(r % 3 == 0, "dominant_region").otherwise("single_region")).otherwise("ambiguous_region").alias("location_selection_status"),
        F.when(r % 7 > 0, F.concat(F.lit("Place "), r)).alias("location_name"), F.col("user_id").cast("string").alias("source_domain"),
        F.concat(F.lit("https://s"), F.col("user_id"), F.lit(".test/"), F.col("event_id")).alias("canonical_url"),
        F.get_json_object("props", "$.k").alias("duplicate_group_id"), F.when(F.col("value") >= 50, "high").otherwise("weak").alias("disaster_match_strength"),
        F.array(F.upper("event_type"), F.concat(F.lit("T_"), r % 5)).alias("matched_disaster_themes"), F.col("value").alias("tone"))


ARTICLES = """articles AS (
  SELECT CAST(event_id AS VARCHAR) AS article_id, ts AS seen_at, event_type AS disaster_type,
    CASE WHEN user_id % 20 > 0 THEN 'C' || (user_id % 20) % 4 END AS country_code, CASE WHEN user_id % 20 > 0 THEN 'A' || (user_id % 20) END AS adm1_code,
    CASE WHEN user_id % 20 = 0 THEN 'ambiguous_region' WHEN (user_id % 20) % 3 = 0 THEN 'dominant_region' ELSE 'single_region' END AS location_selection_status,
    CASE WHEN (user_id % 20) % 7 > 0 THEN 'Place ' || (user_id % 20) END AS location_name, CAST(user_id AS VARCHAR) AS source_domain,
    'https://s' || user_id || '.test/' || event_id AS canonical_url,
    json_extract_string(props, '$.k') AS duplicate_group_id, CASE WHEN value >= 50 THEN 'high' ELSE 'weak' END AS disaster_match_strength,
    [upper(event_type), 'T_' || (user_id % 20) % 5] AS matched_disaster_themes, value AS tone,
    CASE WHEN user_id % 20 > 0 THEN 'C' || (user_id % 20) % 4 || ':A' || (user_id % 20) ELSE 'UNKNOWN' END AS region_id
  FROM events)"""
FEATURES = ARTICLES + """, hourly AS (
  SELECT date_trunc('hour', seen_at) AS window_start, region_id, any_value(CASE WHEN region_id <> 'UNKNOWN' THEN country_code END) AS country_code,
    any_value(CASE WHEN region_id <> 'UNKNOWN' THEN adm1_code END) AS adm1_code, disaster_type,
    count(*) AS article_count, count(*) FILTER (disaster_match_strength = 'high') AS high_confidence_article_count, count(*) FILTER (disaster_match_strength = 'weak') AS weak_article_count,
    count(DISTINCT source_domain) AS unique_domain_count,
    count(DISTINCT duplicate_group_id) + CAST(bool_or(duplicate_group_id IS NULL) AS BIGINT) AS estimated_unique_story_count,
    count(DISTINCT duplicate_group_id) FILTER (disaster_match_strength = 'high') + CAST(coalesce(bool_or(duplicate_group_id IS NULL) FILTER (disaster_match_strength = 'high'), false) AS BIGINT) AS high_confidence_story_count,
    round(avg(tone), 6) AS average_tone, count(*) FILTER (region_id <> 'UNKNOWN') AS location_confident_article_count, count(*) FILTER (region_id = 'UNKNOWN') AS location_review_article_count
  FROM articles GROUP BY 1, 2, 5)"""


@query(f"""WITH {ARTICLES}, per_domain AS (
  SELECT date_trunc('hour', seen_at) AS h, disaster_type AS t, ifnull(location_name, 'Unknown') AS l, ifnull(country_code, 'Unknown') AS c, source_domain AS d, count(*) AS n
  FROM articles GROUP BY 1, 2, 3, 4, 5)
SELECT h AS window_start, t AS disaster_type, l AS location_name, c AS country_code, CAST(sum(n) AS BIGINT) AS article_count, count(d) AS unique_domain_count
FROM per_domain WHERE h IS NOT NULL GROUP BY 1, 2, 3, 4""")
def hourly_counts(spark, sf_dir):
    return features.hourly_counts(articles(spark, sf_dir))


@query(f"WITH {FEATURES} SELECT *, round(1 - estimated_unique_story_count / article_count, 6) AS duplicate_ratio FROM hourly")
def hour_features(spark, sf_dir):
    f = features.hour_features(articles(spark, sf_dir))
    return f.withColumns({c: F.round(c, 6) for c in ("average_tone", "duplicate_ratio")})


@query(f"""WITH {FEATURES} SELECT a.window_start, a.region_id, a.disaster_type, b.estimated_unique_story_count AS previous_story_count, b.unique_domain_count AS previous_domain_count,
  a.estimated_unique_story_count - b.estimated_unique_story_count AS article_velocity, a.unique_domain_count - b.unique_domain_count AS domain_velocity
FROM hourly a LEFT JOIN hourly b ON a.region_id = b.region_id AND a.disaster_type = b.disaster_type AND a.window_start = b.window_start + INTERVAL 1 HOUR""")
def feature_velocity(spark, sf_dir):
    return features.build_features(articles(spark, sf_dir)).select("window_start", "region_id", "disaster_type", "previous_story_count", "previous_domain_count", "article_velocity", "domain_velocity")


DENSE = FEATURES + """, hours AS (SELECT unnest(generate_series((SELECT min(window_start) FROM hourly), (SELECT max(window_start) FROM hourly), INTERVAL 1 HOUR)) AS window_start),
series AS (SELECT region_id, disaster_type, max(country_code) AS country_code, max(adm1_code) AS adm1_code FROM hourly GROUP BY ALL),
dense AS (SELECT h.window_start, s.region_id, s.disaster_type, s.country_code, s.adm1_code, f.article_count IS NOT NULL AS observed_feature_row, coalesce(f.article_count, 0) AS article_count,
  coalesce(f.estimated_unique_story_count, 0) AS estimated_unique_story_count, coalesce(f.high_confidence_story_count, 0) AS high_confidence_story_count, coalesce(f.unique_domain_count, 0) AS unique_domain_count
  FROM hours h CROSS JOIN series s LEFT JOIN hourly f ON f.window_start = h.window_start AND f.region_id = s.region_id AND f.disaster_type = s.disaster_type)"""


@query(f"WITH {DENSE} SELECT * FROM dense")
def densified_hours(spark, sf_dir):
    return anomalies.densified(features.hour_features(articles(spark, sf_dir)))


def _baseline(lookback: int, least: int) -> str:
    w = f"OVER (PARTITION BY region_id, disaster_type ORDER BY window_start ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"
    x = "high_confidence_story_count"
    return f"""{DENSE}, base AS (SELECT *, count(*) {w} AS n, CAST(median({x}) {w} AS DOUBLE) AS m, CAST(mad({x}) {w} AS DOUBLE) AS d FROM dense),
based AS (SELECT * EXCLUDE (n, m, d), n AS baseline_history_hours, CASE WHEN n >= {least} THEN m END AS baseline_median, CASE WHEN n >= {least} THEN d END AS baseline_mad FROM base)"""


@query(f"WITH {_baseline(24, 12)} SELECT window_start, region_id, disaster_type, baseline_history_hours, baseline_median, baseline_mad FROM based")
def rolling_median_mad(spark, sf_dir):
    return anomalies.native_baseline(anomalies.densified(features.hour_features(articles(spark, sf_dir))), 24, 12)


SCORED = f"""{_baseline(720, 168)}, scored AS (
  SELECT *, CASE WHEN baseline_mad > 0 THEN (high_confidence_story_count - baseline_median) / (1.4826 * baseline_mad) END AS robust_z_score FROM based),
judged AS (SELECT *, CASE WHEN baseline_history_hours < 168 THEN 'insufficient_history'
    WHEN high_confidence_story_count < LEAST_STORIES OR unique_domain_count < LEAST_DOMAINS THEN 'below_minimum_support'
    WHEN baseline_median IS NULL OR high_confidence_story_count - baseline_median < LEAST_INCREASE THEN 'normal'
    WHEN baseline_mad = 0 OR robust_z_score >= Z THEN 'candidate_anomaly' ELSE 'normal' END AS anomaly_status FROM scored)"""
#: The gate is looser than by default, since a region of the events table has few stories an hour.
GATE = {"minimum_stories": 2, "minimum_domains": 2, "minimum_story_increase": 1, "z_threshold": 2.0}
for _name, _value in (("LEAST_STORIES", 2), ("LEAST_DOMAINS", 2), ("LEAST_INCREASE", 1), ("Z", 2.0)):
    SCORED = SCORED.replace(f" {_name}", f" {_value}")


def _scored(spark, sf_dir):
    return anomalies.score(features.hour_features(articles(spark, sf_dir)), check=False, **GATE)


@query(f"WITH {SCORED} SELECT * EXCLUDE (robust_z_score), round(robust_z_score, 6) AS robust_z_score, anomaly_status = 'candidate_anomaly' AS is_candidate_anomaly FROM judged")
def anomaly_scored(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("robust_z_score", F.round("robust_z_score", 6))


@query(f"WITH {SCORED} SELECT anomaly_status, count(*) AS row_count FROM judged GROUP BY 1")
def anomaly_status_counts(spark, sf_dir):
    return anomalies.status_counts(_scored(spark, sf_dir))


@query(f"""WITH {SCORED} SELECT window_start, region_id, disaster_type, high_confidence_story_count, unique_domain_count, baseline_median, baseline_mad, round(robust_z_score, 6) AS robust_z_score
FROM judged WHERE anomaly_status = 'candidate_anomaly'
ORDER BY judged.robust_z_score DESC NULLS LAST, high_confidence_story_count DESC, unique_domain_count DESC, window_start, region_id, disaster_type LIMIT 20""")
def top_candidates(spark, sf_dir):
    return anomalies.top_candidates(_scored(spark, sf_dir)).withColumn("robust_z_score", F.round("robust_z_score", 6))


@query(f"""WITH {SCORED}, pool AS (SELECT * FROM judged WHERE anomaly_status = 'candidate_anomaly' OR (NOT EXISTS (SELECT 1 FROM judged WHERE anomaly_status = 'candidate_anomaly')
  AND anomaly_status = 'normal' AND window_start = (SELECT max(window_start) FROM judged WHERE anomaly_status = 'normal')))
SELECT window_start, region_id, disaster_type, anomaly_status, round(robust_z_score, 6) AS robust_z_score FROM pool
ORDER BY pool.robust_z_score DESC NULLS FIRST, window_start DESC, region_id, disaster_type LIMIT 8""")
def selected_signals(spark, sf_dir):
    return evidence.selected_signals(_scored(spark, sf_dir)).select("window_start", "region_id", "disaster_type", "anomaly_status", F.round("robust_z_score", 6).alias("robust_z_score"))


MERGE_DAY, MERGE_END = "2024-01-10", "2024-01-11"


@query(f"""WITH {FEATURES}, feat AS (SELECT window_start, region_id, disaster_type, unique_domain_count, estimated_unique_story_count FROM hourly),
batch AS (SELECT * REPLACE (estimated_unique_story_count + 1 AS estimated_unique_story_count) FROM feat WHERE window_start >= TIMESTAMP '{MERGE_DAY}' AND region_id <> 'UNKNOWN'),
kept AS (SELECT * FROM feat h WHERE window_start < TIMESTAMP '{MERGE_END}' AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.window_start = h.window_start AND b.disaster_type = h.disaster_type)),
merged AS (SELECT * FROM kept UNION ALL SELECT * FROM batch)
SELECT a.*, b.estimated_unique_story_count AS previous_story_count, b.unique_domain_count AS previous_domain_count,
  a.estimated_unique_story_count - b.estimated_unique_story_count AS article_velocity, a.unique_domain_count - b.unique_domain_count AS domain_velocity
FROM merged a LEFT JOIN merged b ON a.region_id = b.region_id AND a.disaster_type = b.disaster_type AND a.window_start = b.window_start + INTERVAL 1 HOUR""")
def history_merge(spark, sf_dir):
    cols = ["window_start", "region_id", "disaster_type", "unique_domain_count", "estimated_unique_story_count", "previous_story_count", "previous_domain_count", "article_velocity", "domain_velocity"]
    f = features.build_features(articles(spark, sf_dir)).select(*cols)
    batch = f.where(f"window_start >= '{MERGE_DAY}' and region_id <> 'UNKNOWN'").withColumn("estimated_unique_story_count", F.col("estimated_unique_story_count") + 1)
    return features.merge_history(f.where(f"window_start < '{MERGE_END}'"), batch)


@query(f"""WITH {ARTICLES}, b AS (SELECT *, disaster_match_strength || ':' || CASE WHEN location_selection_status IN ('missing', 'ambiguous_region', 'unresolved_region') THEN 'needs_location_review' ELSE 'assigned_location' END AS review_bucket FROM articles),
t AS (SELECT *, row_number() OVER (PARTITION BY review_bucket ORDER BY CASE location_selection_status WHEN 'ambiguous_region' THEN 0 WHEN 'unresolved_region' THEN 1 WHEN 'missing' THEN 2 WHEN 'dominant_region' THEN 3 WHEN 'single_region' THEN 4 ELSE 5 END, article_id) AS turn FROM b)
SELECT review_bucket, article_id, location_selection_status FROM t ORDER BY turn, review_bucket LIMIT 40""")
def round_robin_review(spark, sf_dir):
    rows = articles(spark, sf_dir)
    missing = {c: F.lit(None).cast("string") for c in reports.REVIEW_COLUMNS if c not in rows.columns}
    return reports.review_sample(rows.withColumns(missing), 40).select("review_bucket", "article_id", "location_selection_status")


_SHEET = """sheet AS (SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'high' ELSE 'weak' END AS strength, CASE WHEN l.toxic = 1 THEN 'uncertain' WHEN l.quality = 1 THEN 'relevant' WHEN l.quality = 0 THEN 'not_relevant' ELSE '' END AS said,
  CASE d.doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'UNCERTAIN' ELSE 'US:A' || d.doc_id % 3 END AS region, CASE WHEN d.doc_id % 7 = 0 THEN 'UNKNOWN' WHEN d.doc_id % 11 = 0 THEN 'US' ELSE 'US:A' || d.doc_id % 4 END AS machine FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"""WITH {_SHEET}, by_strength AS (SELECT strength, count(*) AS labeled_rows, count(*) FILTER (said = 'relevant') AS relevant_rows FROM sheet WHERE said IN ('relevant', 'not_relevant') GROUP BY 1),
whole AS (SELECT count(*) AS review_rows, count(*) FILTER (said IN ('relevant', 'not_relevant')) AS labeled_rows, count(*) FILTER (said = '') AS unlabeled_rows, count(*) FILTER (said = 'uncertain') AS uncertain_rows, count(*) FILTER (said = 'relevant') AS relevant_rows,
  count(*) FILTER (region NOT IN ('', 'UNCERTAIN')) AS region_labeled_rows, count(*) FILTER (region = '') AS region_unlabeled_rows, count(*) FILTER (region = 'UNCERTAIN') AS region_uncertain_rows, count(*) FILTER (region = machine) AS region_correct_rows FROM sheet)
SELECT '' AS strength, *, round(relevant_rows / nullif(labeled_rows, 0), 6) AS relevance_rate, round(region_correct_rows / nullif(region_labeled_rows, 0), 6) AS region_accuracy FROM whole
UNION ALL SELECT strength, NULL, labeled_rows, NULL, NULL, relevant_rows, NULL, NULL, NULL, NULL, round(relevant_rows / nullif(labeled_rows, 0), 6), NULL FROM by_strength""")
def review_scorecard(spark, sf_dir):
    """Every figure of the scorecard over documents as a labelled sheet: a row for the whole and one for each strength."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sheet = d.selectExpr(
        "if(lang = 'en', ' High', 'weak') AS disaster_match_strength", "CASE WHEN doc_id % 7 = 0 THEN 'ambiguous_region' WHEN doc_id % 2 = 0 THEN 'single_region' ELSE 'dominant_region' END AS location_selection_status",
        "'us' AS country_code", "if(doc_id % 11 = 0, '', concat('a', doc_id % 4)) AS adm1_code",
        "CASE WHEN toxic = 1 THEN 'Uncertain' WHEN quality = 1 THEN ' relevant' WHEN quality = 0 THEN 'NOT_RELEVANT ' END AS label_disaster_relevance",
        "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'uncertain' ELSE concat('us:a', doc_id % 3) END AS label_primary_region")
    card = reports.scorecard(sheet)
    r, p = card["relevance"], card["primary_region"]
    short = lambda x: None if x is None else round(x, 6)
    whole = ("", card["review_rows"], r["labeled_rows"], r["unlabeled_rows"], r["uncertain_rows"], r["relevant_rows"], p["labeled_rows"], p["unlabeled_rows"], p["uncertain_rows"], p["correct_rows"], short(r["overall_relevance_rate"]), short(p["accuracy"]))
    parts = [(k, None, v["labeled"], None, None, v["relevant"], None, None, None, None, short(v["relevance_rate"]), None) for k, v in r["by_match_strength"].items()]
    names = ["review_rows", "labeled_rows", "unlabeled_rows", "uncertain_rows", "relevant_rows", "region_labeled_rows", "region_unlabeled_rows", "region_uncertain_rows", "region_correct_rows"]
    return spark.createDataFrame([whole, *parts], "strength string, " + ", ".join(f"{n} long" for n in names) + ", relevance_rate double, region_accuracy double")


@query("SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY conv_id")
def latest_turn(spark, sf_dir):
    return reports.latest_by(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


#: For the ASCII http(s) URLs of the pages table, whose paths and queries need no re-encoding.
_PAGE_PARTS = """parts AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
  regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path, list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))) AS q FROM pages),
canon AS (SELECT page_id, scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url, host, path FROM parts)"""


@query(f"WITH {_PAGE_PARTS} SELECT page_id, canonical_url, host AS source_domain, sha256(canonical_url) AS article_id FROM canon")
def url_identity(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.url_identity("url").alias("u"))
    return p.select("page_id", "u.canonical_url", "u.source_domain", urls.article_id(F.col("u.canonical_url"), F.col("url")).alias("article_id"))


@query(f"WITH {_PAGE_PARTS} SELECT host AS source_domain, count(*) AS pages, count(DISTINCT canonical_url) AS articles FROM canon GROUP BY 1")
def url_domain_counts(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select(urls.url_identity("url").alias("u")).select("u.*")
    return u.groupBy("source_domain").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("canonical_url").alias("articles"))


#: Documents' texts become slugs: all their runs of letters and digits.
_SLUGS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, text FROM documents),
s AS (SELECT doc_id, list_filter(w, lambda x: NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('article', 'index', 'news', 'story', 'update', 'latest')) AS w FROM w),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN sha256('flood|2024010106|' || array_to_string(w, '-')) ELSE sha256('https://d.test/' || doc_id) END AS group_id, CASE WHEN len(w) >= 5 THEN 'url_slug_6h' ELSE 'canonical_url' END AS method FROM s)"""


@query(f"WITH {_SLUGS} SELECT doc_id, group_id, method, count(*) OVER (PARTITION BY group_id) AS group_size FROM g")
def story_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    url = F.concat(F.lit("https://d.test/"), F.array_join(words, "-"))
    rows = d.select("doc_id", urls.url_identity(url)["slug"].alias("slug"))
    own = urls.article_id(F.concat(F.lit("https://d.test/"), "doc_id"), F.lit(None))
    bucket = text.six_hours_of(F.lit("2024-01-01 07:30:00").cast("timestamp_ntz"))
    rows = rows.select("doc_id", urls.story_group(F.col("slug"), bucket, F.lit("flood"), own).alias("g")).select("doc_id", F.col("g.id").alias("group_id"), F.col("g.method").alias("method"))
    return rows.withColumn("group_size", F.expr("count(*) over (partition by group_id)"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def first_wins_dedup(spark, sf_dir):
    return silver.first_wins(table(spark, sf_dir, "lineitem"), "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")


def _themed(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    marks = F.array(*(F.lit(x) for x in _MARKS))
    first = F.concat(F.lit(" "), F.regexp_replace("p_type", " ", ";"), F.lit(",12;"), F.lower(F.element_at(marks, (F.col("p_partkey") % len(_MARKS) + 1).cast("int"))))
    second = F.concat(F.element_at(marks, (F.col("p_size") % len(_MARKS) + 1).cast("int")), F.lit(",7;;"))
    return p.select("p_partkey", text.theme_tokens(first, second).alias("themes"))


_MARKS = ["NATURAL_DISASTER_FLOOD", "WB_154_FLOOD_PROTECTION", "NATURAL_DISASTER_FLOODED", "WILDFIRE", "NATURAL_DISASTER_WILDFIRE", "FLOOD", "TAX_DISEASE", "CRISIS_FOREST_FIRE"]
_TOKENS = f"""raw AS (SELECT p_partkey, ' ' || replace(p_type, ' ', ';') || ',12;' || lower({_MARKS!r}[CAST(p_partkey % {len(_MARKS)} AS INT) + 1]) || ';' || {_MARKS!r}[p_size % {len(_MARKS)} + 1] || ',7;;' AS s FROM part),
tokens AS (SELECT p_partkey, list_distinct(list_filter(list_transform(string_split(s, ';'), lambda x: upper(trim(string_split(x, ',')[1]))), lambda x: x <> '')) AS themes FROM raw)"""


@query(f"WITH {_TOKENS} SELECT p_partkey, array_to_string(list_sort(themes), ';') AS themes FROM tokens")
def theme_tokens(spark, sf_dir):
    return _themed(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort("themes"), ";").alias("themes"))


@query(f"""WITH {_TOKENS}, m AS (SELECT p_partkey, list_filter(themes, lambda t: contains(t, 'FLOOD')) AS f, list_filter(themes, lambda t: contains(t, 'WILDFIRE') OR contains(t, 'FOREST_FIRE') OR contains(t, 'WILD_FIRE')) AS w FROM tokens)
SELECT p_partkey,
  CASE WHEN len(f) = 0 THEN NULL WHEN len(list_filter(f, lambda t: t = 'FLOOD' OR (regexp_matches(t, '_(FLOOD|FLOODS|FLOODING|FLASH_FLOODS)$') AND NOT starts_with(t, 'WB_')))) > 0 THEN 'high' ELSE 'weak' END AS flood,
  CASE WHEN len(w) = 0 THEN NULL WHEN len(list_filter(w, lambda t: regexp_matches(t, '_(WILDFIRE|WILDFIRES|FOREST_FIRE|WILD_FIRE)$'))) > 0 THEN 'high' ELSE 'weak' END AS wildfire FROM m""")
def classify_strength(spark, sf_dir):
    kind = lambda h: text.match_strength(text.matched_themes("themes", h), h).alias(h)
    return _themed(spark, sf_dir).select("p_partkey", kind("flood"), kind("wildfire"))


@query(f"WITH {_TOKENS}, x AS (SELECT unnest(themes) AS theme FROM tokens) SELECT theme, count(*) AS article_count FROM x GROUP BY 1")
def theme_explode_counts(spark, sf_dir):
    return reports.theme_counts(_themed(spark, sf_dir).withColumnRenamed("themes", "matched_disaster_themes")).withColumnRenamed("matched_disaster_themes", "theme")


#: Each order's line items as mentions of places; the sort makes first-seen order the same on both sides.
_MENTION = """concat_ws('#', 1 + l_linenumber % 5, 'N' || l_partkey % 9, 'c' || l_suppkey % 3, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'a' || l_partkey % 4 END, '', l_partkey % 100, 150 + l_suppkey % 40, 'f' || l_partkey % 9, l_linenumber * 10)"""


def _placed(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "struct(l_linenumber, l_partkey, l_suppkey) AS k", f"{_MENTION} AS m")
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]), ";")
    places = rows.groupBy("l_orderkey").agg(raw.alias("raw")).withColumn("places", locations.parse_locations("raw"))
    out = places.withColumn("ranked", locations.ranked_regions(F.col("places")))
    return out.withColumn("status", locations.selection_status(F.col("places"), F.col("ranked")))


_PLACES = """m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, 1 + l_linenumber % 5 AS kind, 'N' || l_partkey % 9 AS name, 'C' || l_suppkey % 3 AS country,
  CASE WHEN l_partkey % 4 > 0 THEN 'A' || l_partkey % 4 END AS adm1, CAST(l_partkey % 100 AS DOUBLE) AS lat, CAST(150 + l_suppkey % 40 AS DOUBLE) AS lon, l_linenumber * 10 AS pos FROM lineitem),
v AS (SELECT *, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS valid, country || coalesce(':' || adm1, '') AS region FROM m),
r AS (SELECT l_orderkey, region, count(*) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, region) AS rk FROM v GROUP BY 1, 2),
st AS (SELECT l_orderkey, string_agg(region, '|' ORDER BY rk) AS candidates, max(region) FILTER (rk = 1) AS top, CASE WHEN count(*) = 1 THEN 'single_region' WHEN max(n) FILTER (rk = 1) >= 2 * max(n) FILTER (rk = 2) THEN 'dominant_region' ELSE 'ambiguous_region' END AS status FROM r GROUP BY 1),
k AS (SELECT l_orderkey, kind, name, country, adm1, lat, lon, any_value(valid) AS valid, any_value(region) AS region, count(*) AS mentions, min(pos) AS pos, min(i) AS i FROM v GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


@query("SELECT l_orderkey, count(*) AS mentions, count(*) FILTER (l_partkey % 100 <= 90 AND 150 + l_suppkey % 40 <= 180) AS valid, CAST(sum(l_partkey % 100) AS BIGINT) AS lats, CAST(sum(l_linenumber * 10) AS BIGINT) AS offsets FROM lineitem GROUP BY 1")
def location_parse(spark, sf_dir):
    p = _placed(spark, sf_dir).select("l_orderkey", F.explode("places").alias("p"))
    return p.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("mentions"), F.count_if("p.valid").alias("valid"), F.sum("p.lat").cast("long").alias("lats"), F.sum("p.at").alias("offsets"))


@query(f"WITH {_PLACES} SELECT l_orderkey, candidates, status, (SELECT count(*) FROM k WHERE k.l_orderkey = st.l_orderkey) AS places FROM st")
def candidate_regions(spark, sf_dir):
    return _placed(spark, sf_dir).select("l_orderkey", F.array_join("ranked.region", "|").alias("candidates"), "status", locations.distinct_places(F.col("places")).cast("long").alias("places"))


@query(f"""WITH {_PLACES}, c AS (SELECT k.*, row_number() OVER (PARTITION BY k.l_orderkey ORDER BY valid DESC, CASE WHEN kind IN (3, 4) THEN 4 WHEN kind IN (2, 5) THEN 3 WHEN kind = 1 THEN 2 ELSE 1 END DESC, mentions DESC, k.pos, k.i) AS rk
  FROM k JOIN st USING (l_orderkey) WHERE status = 'ambiguous_region' OR k.region = st.top)
SELECT l_orderkey, kind, name, country, adm1, lat, lon, valid FROM c WHERE rk = 1""")
def primary_location(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    return rows.select("l_orderkey", locations.primary_place(F.col("places"), F.col("status"), F.col("ranked")).alias("p")).select("l_orderkey", F.col("p.kind").cast("int").alias("kind"), "p.name", "p.country", "p.adm1", "p.lat", "p.lon", "p.valid")


@query(f"""WITH {_PLACES}, c AS (SELECT l_orderkey, count(DISTINCT (kind, name, country, adm1, lat, lon)) AS n, bool_or(valid) AS ok FROM v GROUP BY 1)
SELECT count(*) FILTER (NOT ok) AS invalid_coordinates, count(*) FILTER (n > 1) AS multiple_locations, count(*) FILTER (status = 'ambiguous_region') AS ambiguous_region FROM c JOIN st USING (l_orderkey)""")
def flag_counts(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    flags = text.flags(
        ("invalid_coordinates", ~F.exists("places", lambda p: p["valid"])), ("multiple_locations", locations.distinct_places(F.col("places")) > 1), ("ambiguous_region", F.col("status") == "ambiguous_region"))
    has = lambda f: F.count_if(F.array_contains("f", f)).alias(f)
    return rows.select(flags.alias("f")).agg(has("invalid_coordinates"), has("multiple_locations"), has("ambiguous_region"))


def _records(spark, sf_dir) -> DataFrame:
    """Orders as raw records, their line items as the places mentioned; customers repeat URLs."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o_orderkey", "struct(l_linenumber, l_partkey, l_suppkey) AS k", f"{_MENTION} AS m")
    places = rows.groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]), ";").alias("places"))
    marks = f"array({', '.join(map(repr, _MARKS))})"
    url = "concat('HTTPS://u@Site', o_custkey % 5, '.Test:443//news/', if(o_custkey % 4 = 0, 'latest-1', concat('Big-flood-hits-town-w', o_custkey)), '.html/?utm_Source=x&b=', o_custkey % 3, '&a=1#top')"
    return table(spark, sf_dir, "orders").join(places, "o_orderkey", "left").selectExpr(
        "if(o_orderkey % 9 = 0, '', concat('r', o_orderkey)) AS GKGRECORDID", "if(o_orderkey % 13 = 0, 'bad', concat(date_format(o_orderdate, 'yyyyMMdd'), lpad(o_orderkey % 24, 2, '0'), '1500')) AS `V2.1DATE`",
        "concat('common', o_custkey % 3) AS V2SOURCECOMMONNAME", f"if(o_custkey % 11 = 0, concat(' no url ', o_custkey), {url}) AS V2DOCUMENTIDENTIFIER",
        f"concat(lower({marks}[int(o_orderkey % {len(_MARKS)})]), ',3;CRISIS') AS V1THEMES", f"concat({marks}[int(o_custkey % {len(_MARKS)})], ',10;') AS V2ENHANCEDTHEMES",
        "if(o_orderkey % 17 = 0, '', places) AS V2ENHANCEDLOCATIONS", "concat(o_orderkey % 100 - 50, '.5,1,2') AS `V1.5TONE`", "'orders' AS _source_file", "0 AS _file_ord", "o_orderkey AS _row_ord")


_SILVER = f"""WITH {_PLACES}, prim AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY k.l_orderkey ORDER BY valid DESC, CASE WHEN kind IN (3, 4) THEN 4 WHEN kind IN (2, 5) THEN 3 WHEN kind = 1 THEN 2 ELSE 1 END DESC, mentions DESC, k.pos, k.i) AS rk
  FROM k JOIN st USING (l_orderkey) WHERE status = 'ambiguous_region' OR k.region = st.top) WHERE rk = 1),
rec AS (SELECT o_orderkey AS o, o_custkey AS c, {_MARKS!r}[CAST(o_orderkey % {len(_MARKS)} AS INT) + 1] AS m1, {_MARKS!r}[CAST(o_custkey % {len(_MARKS)} AS INT) + 1] AS m2,
  CASE WHEN o_orderkey % 13 > 0 THEN date_trunc('day', o_orderdate) + to_hours(CAST(o_orderkey % 24 AS INT)) + INTERVAL 15 MINUTE END AS seen_at,
  CASE WHEN o_custkey % 11 > 0 THEN 'https://site' || o_custkey % 5 || '.test/news/' || CASE WHEN o_custkey % 4 = 0 THEN 'latest-1' ELSE 'Big-flood-hits-town-w' || o_custkey END || '.html?a=1&b=' || o_custkey % 3 END AS canonical_url,
  CASE WHEN o_custkey % 11 > 0 AND o_custkey % 4 > 0 THEN 'big-flood-hits-town-w' || o_custkey END AS slug FROM orders),
tok AS (SELECT *, CASE WHEN m1 = m2 THEN [m1, 'CRISIS'] ELSE [m1, 'CRISIS', m2] END AS themes, sha256(coalesce(canonical_url, 'no url ' || c)) AS article_id FROM rec),
mat AS (SELECT *, list_filter(themes, lambda t: contains(t, 'FLOOD')) AS matched FROM tok),
cls AS (SELECT *, CASE WHEN len(matched) = 0 THEN NULL WHEN len(list_filter(matched, lambda t: t = 'FLOOD' OR (regexp_matches(t, '_(FLOOD|FLOODS|FLOODING|FLASH_FLOODS)$') AND NOT starts_with(t, 'WB_')))) > 0 THEN 'high' ELSE 'weak' END AS strength FROM mat),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY o) AS rn FROM cls WHERE strength IS NOT NULL) WHERE rn = 1),
full_ AS (SELECT once.*, p.name, p.country, p.adm1, p.lat, p.lon, p.valid, coalesce(st.status, 'missing') AS status, coalesce(st.candidates, '') AS candidates, (SELECT count(*) FROM k WHERE k.l_orderkey = p.l_orderkey) AS places,
  CASE WHEN slug IS NOT NULL AND seen_at IS NOT NULL THEN sha256('flood|' || strftime(time_bucket(INTERVAL 6 HOUR, seen_at, TIMESTAMP '2000-01-01'), '%Y%m%d%H') || '|' || slug) ELSE article_id END AS group_id
  FROM once LEFT JOIN prim p ON p.l_orderkey = once.o AND once.o % 17 > 0 LEFT JOIN st ON st.l_orderkey = once.o AND once.o % 17 > 0)"""


@query(_SILVER + """ SELECT 'orders' AS source_file, CASE WHEN o % 9 = 0 THEN article_id ELSE 'r' || o END AS record_id, article_id, seen_at, canonical_url, coalesce('site' || CASE WHEN c % 11 > 0 THEN c % 5 END || '.test', 'common' || c % 3) AS source_domain,
  name AS location_name, country AS country_code, adm1 AS adm1_code, CAST(NULL AS VARCHAR) AS adm2_code, lat AS latitude, lon AS longitude, places AS distinct_location_count, status AS location_selection_status, candidates AS location_candidate_regions,
  'flood' AS disaster_type, strength AS disaster_match_strength, array_to_string(matched, '|') AS matched_disaster_themes, array_to_string(themes, '|') AS themes, o % 100 - 50 + CASE WHEN o % 100 < 50 THEN -0.5 ELSE 0.5 END::DOUBLE AS tone,
  CASE WHEN valid IS NULL THEN 'missing' WHEN valid THEN 'coordinates_valid' ELSE 'location_only' END AS geo_confidence,
  array_to_string(list_filter([CASE WHEN canonical_url IS NULL THEN 'invalid_url' END, CASE WHEN seen_at IS NULL THEN 'invalid_seen_at' END, CASE WHEN valid IS NULL THEN 'missing_location' END, CASE WHEN NOT valid THEN 'invalid_coordinates' END,
    CASE WHEN places > 1 THEN 'multiple_locations' END, CASE WHEN status = 'ambiguous_region' THEN 'ambiguous_region' END], lambda x: x IS NOT NULL), '|') AS quality_flags,
  group_id AS duplicate_group_id, CASE WHEN group_id = article_id THEN 'canonical_url' ELSE 'url_slug_6h' END AS duplicate_group_method, count(*) OVER (PARTITION BY group_id) AS duplicate_group_size FROM full_""")
def silver_articles(spark, sf_dir):
    """The whole way from records to articles, lists as text."""
    found = silver.silver(_records(spark, sf_dir), "flood", "weak")
    return found.withColumns({c: F.array_join(c, "|") for c in ("location_candidate_regions", "matched_disaster_themes", "themes", "quality_flags")})


@query(_SILVER + """, before AS (SELECT count(*) AS input_rows, count(strength) AS theme_matched_rows, count(*) FILTER (strength = 'weak') AS weak_rows_skipped, count(*) FILTER (strength = 'high') AS disaster_rows, count(DISTINCT CASE WHEN strength = 'high' THEN article_id END) AS output_rows FROM cls),
first_ AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY o) AS rn FROM cls WHERE strength = 'high'),
after AS (SELECT count(*) FILTER (status = 'ambiguous_region') AS a, count(*) FILTER (status IN ('ambiguous_region', 'missing', 'unresolved_region')) AS r FROM (SELECT coalesce(st.status, 'missing') AS status FROM first_ f LEFT JOIN st ON st.l_orderkey = f.o AND f.o % 17 > 0 WHERE f.rn = 1))
SELECT input_rows, theme_matched_rows, weak_rows_skipped, disaster_rows, disaster_rows - output_rows AS duplicate_rows, r AS location_review_rows, a AS ambiguous_region_rows, output_rows FROM before, after""")
def silver_counters(spark, sf_dir):
    """The run's counts at the filters and after deduplication, for strong matches."""
    records = _records(spark, sf_dir)
    found = silver.counters(records, silver.silver(records, "flood", "high"), 1, "flood", "high")
    names = [k for k in found if k != "input_files"]
    return spark.createDataFrame([tuple(found[k] for k in names)], ", ".join(f"{k} long" for k in names))


@query(f"""WITH {ARTICLES} SELECT coalesce(location_name, 'Unknown') AS location_name, coalesce(country_code, 'Unknown') AS country_code, count(*) AS article_count,
  count(DISTINCT source_domain) AS unique_domain_count FROM articles GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 10""")
def top_locations(spark, sf_dir):
    return reports.top_locations(articles(spark, sf_dir), 10)


@query(f"""WITH {ARTICLES}, n AS (SELECT *, count(*) OVER (PARTITION BY duplicate_group_id) AS size FROM articles)
SELECT duplicate_group_id, count(*) AS article_count, count(DISTINCT source_domain) AS unique_domain_count, arg_min(canonical_url, (seen_at, article_id)) AS example_url FROM n WHERE size > 1 GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""")
def top_groups_first_row(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("duplicate_group_size", F.expr("count(*) over (partition by duplicate_group_id)")).withColumn("duplicate_group_method", F.lit("k"))
    return reports.top_story_groups(rows, 10).select("duplicate_group_id", "article_count", "unique_domain_count", "example_url")


@query(f"""WITH {ARTICLES} SELECT count(*) AS row_count, count(DISTINCT source_domain) AS unique_domain_count, count(DISTINCT country_code) AS unique_country_count,
  count(DISTINCT duplicate_group_id) + CAST(bool_or(duplicate_group_id IS NULL) AS BIGINT) AS estimated_unique_story_count, count(*) FILTER (location_name IS NULL) AS missing_location_count,
  count(*) FILTER (location_selection_status = 'ambiguous_region') AS location_review_count FROM articles""")
def quality_totals(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumns({"duplicate_group_size": F.lit(1), "quality_flags": F.array().cast("array<string>")})
    return reports.quality_totals(rows).select("row_count", "unique_domain_count", "unique_country_count", "estimated_unique_story_count", "missing_location_count", "location_review_count")


@query(f"""WITH {FEATURES} SELECT window_start, region_id, disaster_type, high_confidence_story_count, unique_domain_count, estimated_unique_story_count FROM hourly
ORDER BY 4 DESC, 5 DESC, 6 DESC, 1, 2, 3 LIMIT 10""")
def top_signals(spark, sf_dir):
    return reports.top_signals(features.hour_features(articles(spark, sf_dir)), 10).select("window_start", "region_id", "disaster_type", "high_confidence_story_count", "unique_domain_count", "estimated_unique_story_count")


@query(f"""WITH {FEATURES} SELECT a.window_start, a.region_id, a.disaster_type, a.estimated_unique_story_count - b.estimated_unique_story_count AS article_velocity
FROM hourly a JOIN hourly b ON a.region_id = b.region_id AND a.disaster_type = b.disaster_type AND a.window_start = b.window_start + INTERVAL 1 HOUR
WHERE a.estimated_unique_story_count > b.estimated_unique_story_count ORDER BY 4 DESC, a.unique_domain_count DESC, 1, 2, 3 LIMIT 10""")
def rising_signals(spark, sf_dir):
    return reports.rising(features.build_features(articles(spark, sf_dir)), 10).select("window_start", "region_id", "disaster_type", "article_velocity")


@query(f"""WITH {FEATURES}, wanted AS (SELECT region_id || '|' || strftime(window_start, '%Y-%m-%dT%H:%M:%S') AS signal_id FROM hourly ORDER BY high_confidence_story_count DESC, unique_domain_count DESC, estimated_unique_story_count DESC, window_start, region_id, disaster_type LIMIT 8),
a AS (SELECT *, region_id || '|' || strftime(date_trunc('hour', seen_at), '%Y-%m-%dT%H:%M:%S') AS signal_id FROM articles WHERE disaster_match_strength = 'high' AND duplicate_group_id IS NOT NULL),
s AS (SELECT signal_id, duplicate_group_id AS story_id, min(seen_at) AS seen, min(location_name) AS location, list_sort(list(DISTINCT ('s' || source_domain || '.test', canonical_url)))[1:8] AS src FROM a WHERE signal_id IN (SELECT signal_id FROM wanted) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY seen, story_id) AS rn FROM s)
SELECT signal_id, story_id, strftime(seen, '%Y-%m-%dT%H:%M:%S') AS seen_at, location, array_to_string(list_transform(src, lambda x: x[2]), ' ') AS urls FROM k WHERE rn <= 8""")
def evidence_bundle(spark, sf_dir):
    rows = articles(spark, sf_dir)
    wanted = reports.top_signals(features.hour_features(rows), 8).select(F.concat_ws("|", "region_id", text.iso("window_start")).alias("signal_id"))
    found = evidence.evidence(rows, wanted).select("signal_id", F.explode("stories").alias("s"))
    return found.select("signal_id", "s.story_id", "s.seen_at", "s.location", F.array_join("s.sources.url", " ").alias("urls"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS bucket, count(*) AS n FROM events GROUP BY 1")
def six_hour_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(text.six_hours_of("ts").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(unnest(generate_series((SELECT max(ts) FROM events) - INTERVAL (15 * 95) MINUTE, (SELECT max(ts) FROM events), INTERVAL 15 MINUTE)), '%Y%m%d%H%M%S') AS stamp")
def window_stamps(spark, sf_dir):
    return downloads.window_stamps(table(spark, sf_dir, "events").agg(F.max("ts").alias("end")), "end", 96)
