"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import embedding_dedup, license_scan, line_dedup, minhash_dedup, mixing, packing, quality_classifier, quality_rules, sharding, url_filter
from tidewatch.llm.common import table

ORACLES: dict[str, str] = {"op4_license_scan": license_scan.ORACLE, "op7_url_filter": url_filter.ORACLE}


def op1_embedding_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op2_bayes_hinge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.minimax_shards(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, listed = url_filter.as_list(spark, url_filter.RULES), url_filter.as_list(spark, url_filter.LISTED)
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules, listed)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_graphs, op2_bayes_hinge, op3_minimax_sharding, op4_license_scan, op5_fuzzy_lines, op6_minhash_join, op7_url_filter, op8_quality_rules, op9_mix_sources, op10_mixture_packing)}
