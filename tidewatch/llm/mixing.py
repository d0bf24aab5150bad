"""Mixing sources to target weights by subset-sum budget fitting.

Every source takes whole rounds of its documents while its target allows, and
fits the remaining budget with a subset: documents are counted by exact length;
each length gives its proportional share, rounded down; what is then left of
the budget, at most some lengths' worth, is met by bounded-knapsack dynamic
programming over the lengths' leftover counts (after largest-first steps, if it
is beyond the table's bound; should these miss the budget, over a larger table). Within a length, documents are taken in the order
of a seeded hash of doc_id, so reruns agree.

The histogram of a source has a row per distinct length and is what one task
holds. Ranks within a length are counted per hash range, 4096 of them, so a
length that a third of all rows share is spread over many tasks. The driver
holds one row per source.

Defined cases: a null text has no words; documents without words take 0; a null
source is a source of its own, last in order; repeated rows count and rank each
for themselves (take_mix decides by doc_id, so rows repeating one are taken alike);
a very long text is a length of its own; an empty table gives an empty result; columns besides doc_id,
text and source are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, written

#: Words of budget that the first dynamic programming table spans.
TABLE = 1 << 16
RANGE_BITS = 12
#: Rows of the (source, length) table up to which it is broadcast.
BROADCAST_ROWS = 400_000
MOST = 3


def fit_subset(lengths: list[int], left: list[int], budget: int) -> list[int]:
    """How many documents of each length, at most `left`, come closest to `budget` words from below.

    Largest-first steps leave what the table spans; if that doesn't meet the budget exactly, a larger
    table is tried, in the end one over the whole budget, so no sum is closer than the one found.
    """
    table = TABLE
    while True:
        take = _fit(lengths, left, budget, table)
        if table >= budget or sum(a * b for a, b in zip(lengths, take, strict=True)) == budget:
            return take
        table *= 8


def _fit(lengths: list[int], left: list[int], budget: int, table: int) -> list[int]:
    take = [0] * len(lengths)
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0 and left[i] > 0), key=lambda i: -lengths[i])
    for i in order:
        if budget <= table:
            break
        take[i] = min(left[i], -(-(budget - table) // lengths[i]), budget // lengths[i])
        budget -= take[i] * lengths[i]
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    chunk_of = np.full(budget + 1, -1, np.int32)
    chunks: list[tuple[int, int]] = []
    for i in order:
        rest, copies = min(left[i] - take[i], budget // lengths[i]), 1
        while rest > 0 and not reach[budget]:
            n = min(copies, rest)
            weight = n * lengths[i]
            new = reach[:-weight] & ~reach[weight:]
            chunk_of[weight:][new] = len(chunks)
            reach[weight:] |= new
            chunks.append((i, n))
            rest, copies = rest - n, copies * 2
    at = int(np.flatnonzero(reach)[-1])
    while at:  # each sum was first reached by a later chunk than the sum before it
        i, n = chunks[chunk_of[at]]
        take[i] += n
        at -= n * lengths[i]
    return take


def fit_counts(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Documents to take of each length for `budget` words: a proportional share of every length, then the best subset of the rest."""
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    rest = budget - sum(a * b for a, b in zip(lengths, take, strict=True))
    more = fit_subset(lengths, [c - t for c, t in zip(counts, take, strict=True)], rest)
    return [a + b for a, b in zip(take, more, strict=True)]


def targets(sizes: dict, weights: dict) -> dict:
    """Words per source: all words shared by weight; what exceeds MOST times a source's size is shared again among the others."""
    found: dict = {}
    open_, rest = set(sizes), float(sum(sizes.values()))
    while open_:
        by = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if by * weights[s] > MOST * sizes[s]}
        if not full:
            return found | {s: by * weights[s] for s in open_}
        for s in full:
            found[s] = float(MOST * sizes[s])
            rest -= found[s]
        open_ -= full
    return found


def cycle_weights(sources: list) -> dict:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode("utf-32-be", "surrogatepass")) + [None] * (None in sources)
    return {s: k % 3 + 1 for k, s in enumerate(ordered)}


def _plan(found: dict):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        target, size = found[None if pd.isna(source) else source]
        rounds = min(MOST, int(target // size)) if size else 0
        budget = 0 if rounds == MOST else min(size, round(target - rounds * size))
        lengths, counts = pdf["size"].tolist(), pdf["n"].tolist()
        return pd.DataFrame({"source": pdf["source"], "size": lengths, "rounds": rounds, "take": fit_counts(lengths, counts, budget)})

    return of


def mixed(docs: DataFrame, seed: int = 11, weights: dict | None = None) -> tuple[DataFrame, dict]:
    """(doc_id, source, size, copies, key) for each document, and (target, size) by source."""
    d = columns(docs, doc_id="doc_id", text="text", source="source")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    digest = written(d.select("doc_id", "source", words.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("key")))
    ranged = digest.withColumn("part", F.shiftrightunsigned("key", 64 - RANGE_BITS)).withColumn("s", F.struct("source"))
    per_source = {r["source"]: r["n"] for r in digest.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    aims = targets(per_source, weights or cycle_weights(list(per_source)))
    found = {s: (aims[s], n) for s, n in per_source.items()}

    parts = written(ranged.groupBy("s", "size", "part").agg(F.count(F.lit(1)).alias("n")))
    plan = (
        parts.groupBy("s.source", "size").agg(F.sum("n").alias("n"))
        .groupBy("source").applyInPandas(_plan(found), "source string, size long, rounds long, take long")
        .select(F.struct("source").alias("s"), "size", "rounds", "take")
    )
    before = F.coalesce(F.sum("n").over(W.partitionBy("s", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = parts.withColumn("before", before).join(plan, ["s", "size"]).drop("n")
    # Keys that differ only beyond the range bits have one sign, so ordering them as signed numbers is right.
    rank = F.row_number().over(W.partitionBy("s", "size", "part").orderBy("key", "doc_id"))
    copies = F.col("rounds") + (F.col("before") + F.col("rank") <= F.col("take")).cast("long")
    result = ranged.withColumn("rank", rank).join(steps, ["s", "size", "part"]).select("doc_id", "source", "size", copies.alias("copies"), "key")
    return result, found


def mix_sources(docs: DataFrame, seed: int = 11, weights: dict | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each document."""
    result, found = mixed(docs, seed, weights)
    spark = docs.sparkSession
    rows = [(s, n, float(t)) for s, (t, n) in found.items()]
    totals = spark.createDataFrame(rows, "source string, source_size long, target double").select(F.struct("source").alias("s"), "source_size", "target")
    return (
        result.withColumn("s", F.struct("source")).join(F.broadcast(totals), "s")
        .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    )


def take_mix(docs: DataFrame, seed: int = 11, weights: dict | None = None) -> DataFrame:
    """`docs` with each row repeated as often as the mix takes it.

    The rows taken once more than the rest of their source and length are those
    whose key is not above a limit, so a table with a row per source and length
    decides for each document in the scan; text is only shuffled if that table
    is too large to broadcast. Rows that repeat a doc_id share its fate.
    """
    result, _ = mixed(docs, seed, weights)
    flip = F.lit(-(2**63))
    limits = written(
        result.groupBy(F.struct("source").alias("s"), "size")
        .agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.max(F.struct("copies", F.col("key").bitwiseXOR(flip).alias("key"))).alias("top"))
        .select("s", "size", "least", "most", F.col("top.key").alias("limit"))
    )
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    keyed = docs.select(F.struct("*").alias("row"), F.struct("source").alias("s"), words.alias("size"), F.xxhash64(F.lit(seed), "doc_id").bitwiseXOR(flip).alias("key"))
    copies = F.when(F.col("key") <= F.col("limit"), F.col("most")).otherwise(F.col("least")).cast("int")
    return keyed.join(limits, ["s", "size"]).withColumn("copies", copies).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("k")).select("row.*")
