"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a text when a whole-number measure (per mille) reaches its
cutoff. For every stratum (language), rule and cutoff of a fixed grid, an exact
binomial test asks whether the share of good texts rejected can still exceed
the rule's allowance; a cutoff is admissible only if it cannot, at a level
divided by the number of tests (Bonferroni). The allowances of the rules add up
to `risk`, so at confidence 1 - `delta` no stratum loses more than that share
of its good texts to the rules, whichever cutoffs are chosen. Of the admissible
cutoffs the one that catches most bad texts is taken, on ties the laxest. A
stratum with too few good labels to certify anything keeps all of its texts.

Defined cases: a null text counts as empty; texts with no word fail the base
rules; a null language is the stratum ""; null labels are ignored and a doc_id
labelled twice counts as good if any of its labels is; very long texts are measured
whole; an empty table gives an
empty result; rows repeating a doc_id are judged each by its own text; columns
besides the ones named are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, written

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_letters long"

#: Measures in per mille and the cutoffs tried for each.
RULES: dict[str, tuple[str, list[int]]] = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", [50, 100, 150, 200, 300, 400, 500, 700, 900]),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", [100, 200, 300, 400, 500, 600, 700, 800]),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", [25, 50, 75, 100, 125, 150, 175, 200]),
    "capitals": ("1000 * n_capitals div greatest(n_letters, 1)", [100, 200, 300, 400, 500, 600, 700, 800]),
    "word_length": ("1000 * word_chars div greatest(n_words, 1)", [8000, 9000, 10000, 12000, 14000, 16000, 20000]),
}

_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_RNG = np.random.default_rng(20240229)
_MIX = _RNG.integers(1, 2**62, 2 * WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of five consecutive words that the text has twice or more, the first window included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    if len(seen) == len(words):
        return 0
    code = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        x = (ids[k : n + k] + np.uint64(1)) * _MIX[k]
        code = (code ^ (x ^ (x >> np.uint64(31))) * _MIX[WINDOW + k]) * _MIX[k] + (code >> np.uint64(29))
    order = np.sort(code)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(np.isin(code, twice))
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at the six ASCII white-space characters only
    chars = sum(len(w) for w in words) if raw.isascii() else len(b"".join(words).decode("utf-8", "surrogatepass"))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    gone = len(raw) - len(raw.translate(None, SYMBOLS))
    capitals, letters = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _LETTERS))
    return len(words), chars, gone, len(lines) - len(set(lines)), repeat_words(words), len(lines), capitals, letters


NAMES = [x.split()[0] for x in STATS.split(", ")]


def _stats(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in text], columns=NAMES)


def text_stats(text: Column) -> Column:
    """A struct of the measures of a text column."""
    return F.pandas_udf(_stats, STATS)(text)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def certified(k: int, n: int, share: float, level: float) -> bool:
    """Whether k rejections among n good texts rule out, at `level`, a true share above `share` (exact binomial tail)."""
    if k >= n:
        return False
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share) for i in range(k + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(level)


def fit_cutoffs(judged: DataFrame, risk: float = 0.02, delta: float = 0.05) -> dict[str, dict[str, int]]:
    """Certified cutoffs by stratum, from rows (stratum, quality, STATS).

    One aggregation counts, for all labelled rows, what each cutoff would
    reject; only strata with enough good labels to certify a cutoff at all come
    to the driver, one row each.
    """
    share = risk / len(RULES)
    cells = [(rule, cut) for rule, (_, cuts) in RULES.items() for cut in cuts]
    # An upper bound on the strata tested: what has too few good labels can't be certified at any level.
    fewest = math.ceil(math.log(delta) / math.log1p(-share))
    exprs = [F.expr(f"{RULES[r][0]} >= {c}") for r, c in cells]
    good, bad = (F.col("quality") == 1) & ~base_failed(), (F.col("quality") == 0) & ~base_failed()
    counted = judged.groupBy("stratum").agg(
        F.count_if(good).alias("good"),
        *(F.count_if(good & x).alias(f"g{i}") for i, x in enumerate(exprs)),
        *(F.count_if(bad & x).alias(f"b{i}") for i, x in enumerate(exprs)),
    )
    rows = counted.where(F.col("good") >= fewest).collect()
    level = delta / max(1, len(rows) * len(cells))
    found: dict[str, dict[str, int]] = {}
    for row in rows:
        best: dict[str, tuple[int, int]] = {}
        for i, (rule, cut) in enumerate(cells):
            # The number of rejections that can pass is a small share of n, so the sum is short.
            if row[f"b{i}"] and row[f"g{i}"] <= share * row["good"] and certified(row[f"g{i}"], row["good"], share, level):
                best[rule] = max(best.get(rule, (0, 0)), (row[f"b{i}"], cut))
        found[row["stratum"]] = {rule: cut for rule, (_, cut) in best.items()}
    return found


def verdict(stratum: Column, cutoffs: dict[str, dict[str, int]]) -> Column:
    """True where no certified cutoff of the row's stratum is reached."""
    rejected = F.lit(False)
    for name, cuts in sorted(cutoffs.items()):
        for rule, cut in sorted(cuts.items()):
            rejected = rejected | ((stratum == name) & F.expr(f"{RULES[rule][0]} >= {cut}"))
    return ~rejected


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, STATS) for each document; written, since calibration and verdict both read it."""
    d = columns(docs, doc_id="doc_id", text="text", stratum="lang")
    return written(d.select("doc_id", F.coalesce("stratum", F.lit("")).alias("stratum"), text_stats(F.col("text")).alias("s")).select("doc_id", "stratum", "s.*"))


def label_of(labels: DataFrame) -> DataFrame:
    return columns(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, STATS, base_failed, kept for each document."""
    stats = measured(docs)
    cutoffs = fit_cutoffs(stats.join(label_of(labels), "doc_id"), risk, delta)
    failed = base_failed()
    return stats.select("doc_id", *NAMES, failed.alias("base_failed"), (~failed & verdict(F.col("stratum"), cutoffs)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of `docs` that pass, with their columns as they are.

    Measures are taken again in the scan that filters, which costs CPU but
    moves no text.
    """
    cutoffs = fit_cutoffs(measured(docs).join(label_of(labels), "doc_id"), risk, delta)
    flagged = docs.select(
        F.struct("*").alias("row"), F.coalesce("lang", F.lit("")).alias("stratum"), text_stats(F.col("text")).alias("s"),
    ).select("row", "stratum", "s.*")
    return flagged.where(~base_failed() & verdict(F.col("stratum"), cutoffs)).select("row.*")
