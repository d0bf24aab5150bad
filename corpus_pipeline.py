"""The corpus pipeline: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. A stage's result is written as Parquet
and read again as the next one's docs.

Defined cases: null and empty texts fail the rules and go; rows with a null
doc_id, language or source are rows like any other, judged by their text; rows
repeating a doc_id are judged each by its own text, and of equal or near texts
one row stays; very long texts go whole through every stage; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import line_dedup, minhash_dedup, mixing, packing, quality_rules
from tidewatch.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; documents left without a word go."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles stays."""
    return minhash_dedup.drop_near_duplicates(docs, width=5, percent=80, one_per_id=False)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mix_sources", mix), ("pack", packed)]

#: SQL can't express the stages: certified cutoffs, MinHash, knapsack, tokenization. tests/llm hold the operators against brute force, and the stages on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
