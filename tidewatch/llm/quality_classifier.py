"""Quality classifier: a hinge-loss linear model on naive-Bayes-scaled n-gram indicators.

Features are the distinct byte bigrams and trigrams of a whole text and the
distinct bigrams and trigrams of its words' shapes (kinds of the first, second
and last characters, length, and whether the next word is the same), hashed into
2^18 buckets. Every bucket's log-count ratio between the classes comes from all
labelled training documents. An indicator is scaled by its ratio, a document's
vector has length 1, and dual coordinate descent fits the hinge loss with both
classes weighing the same. A logistic curve, fitted to margins of rows kept out
of the descent, turns a margin into the probability of label 1.

The descent sees a bounded sample: at most about FIT_ROWS documents, chosen by a
hash of doc_id. Counts cover all training documents and scores all documents.
The driver and a task hold arrays of 2^18 numbers, whatever the input.

Defined cases: a null text is scored as an empty one, which has only the
constant feature; a null doc_id is scored but never trained on; a doc_id with
contradicting labels is not trained on; with labels of one class only, or none,
every score is the class's smoothed share; rows repeating a doc_id are scored, and
counted in training, each by its own text; very long texts are scored whole; an empty table gives an empty result;
columns besides the ones named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, written
from tidewatch.llm.minhash_dedup import word_hashes

BUCKETS = 1 << 18
FIT_ROWS = 8192
EPOCHS = 12
PENALTY = 1.0
SMOOTH = 1.0
FOLDS = 5
THRESHOLD = 0.3

#: Kinds of bytes: 0 other punctuation, 1 a-z, 2 A-Z, 3 0-9, 4 beyond ASCII, 5 to 7 common marks.
_KIND = np.zeros(256, np.uint32)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[ord(c) for c in ".,"]], _KIND[[ord(c) for c in "!?"]], _KIND[[ord(c) for c in "#*$%&|<>"]] = 5, 6, 7
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(BUCKETS, bool)


def features(text: str | None) -> np.ndarray:
    """The sorted distinct buckets of a text's n-grams; bucket 0 is always one of them."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    b = raw.astype(np.uint32)
    mark = _MARK
    mark[0] = True
    if len(b) > 1:
        two = (b[:-1] << np.uint32(8)) | b[1:]
        mark[two + np.uint32(1 << 17)] = True
        if len(b) > 2:
            three = (two[:-1] << np.uint32(8)) | b[2:]
            mark[(three * np.uint32(2654435761)) >> np.uint32(15)] = True
    edge = np.flatnonzero(np.diff(~_SPACE[raw], prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        same = np.zeros(len(starts), np.uint32)
        h = word_hashes(text)
        same[:-1] = h[1:] == h[:-1]
        n = ends - starts
        second = np.where(n > 1, _KIND[raw[np.minimum(starts + 1, len(raw) - 1)]], 7)
        size = np.searchsorted([3, 6, 10, 16], n, side="left").astype(np.uint32)
        shape = (((_KIND[raw[starts]] * np.uint32(8) + second.astype(np.uint32)) * np.uint32(8) + _KIND[raw[ends - 1]]) * np.uint32(5) + size) * np.uint32(2) + same
        top = np.uint32((1 << 17) + (1 << 16))
        mark[top + ((shape * np.uint32(2246822519)) >> np.uint32(17))] = True
        if len(shape) > 1:
            pair = shape[:-1] * np.uint32(5120) + shape[1:]
            mark[top + np.uint32(1 << 15) + ((pair * np.uint32(3266489917)) >> np.uint32(17))] = True
    found = np.flatnonzero(mark).astype(np.uint32)
    mark[found] = False
    return found


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Class counts of this partition's documents, and the features of those in the sample."""
    counts = np.zeros((2, BUCKETS), np.int64)
    empty = {"bucket": -1, "low": 0, "high": 0}
    for pdf in batches:
        rows = []
        for text, y, sampled in zip(pdf["text"], pdf["quality"].tolist(), pdf["sampled"].tolist(), strict=True):
            f = features(text)
            counts[y, f] += 1
            if sampled:
                rows.append((y, f.tobytes()))
        yield pd.DataFrame(rows, columns=["quality", "features"]).assign(**empty)[["quality", "features", "bucket", "low", "high"]]
    seen = np.flatnonzero(counts.any(0))
    yield pd.DataFrame({"quality": -1, "features": b"", "bucket": seen, "low": counts[0, seen], "high": counts[1, seen]})


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, by bucket, of the hinge-loss model on ratio-scaled unit vectors (dual coordinate descent)."""
    scale = [ratio[f] / (np.linalg.norm(ratio[f]) or 1.0) for f in rows]
    share = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    bound = np.array([PENALTY * len(y) / (2 * share[s]) for s in y.tolist()])
    w, dual, rng = np.zeros(len(ratio)), np.zeros(len(y)), np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, x = rows[i], scale[i]
            q = float(x @ x)
            if not q:
                continue
            new = min(max(dual[i] - (y[i] * float(w[f] @ x) - 1.0) / q, 0.0), bound[i])
            step = new - dual[i]
            if step:
                dual[i] = new
                w[f] += step * y[i] * x
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def margins(rows: list[np.ndarray], w: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    product = w * ratio
    return np.array([product[f].sum() / (np.linalg.norm(ratio[f]) or 1.0) for f in rows])


def curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve for the margins, with smoothed targets (Newton's method)."""
    high, low = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (high + 1) / (high + 2), 1 / (low + 2))
    a, b = 1.0, float(np.log((high + 1) / (low + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        v = np.maximum(p * (1 - p), 1e-9)
        ga, gb = float(((p - target) * m).sum()) + 1e-3 * a, float((p - target).sum())
        haa, hab, hbb = float((v * m * m).sum()) + 1e-3, float((v * m).sum()), float(v.sum()) + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


def _fit(ratio: np.ndarray):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["features", "quality"])
        rows = [np.frombuffer(x, np.uint32) for x in pdf["features"]]
        y = np.where(pdf["quality"].to_numpy() == 1, 1, -1)
        out = np.arange(len(y)) % FOLDS == 0
        if not (y[out] > 0).any() or not (y[out] < 0).any():
            out[:] = False
        kept = np.flatnonzero(~out)
        w = descend([rows[i] for i in kept], y[kept], ratio)
        judged = np.flatnonzero(out) if out.any() else kept
        a, b = curve(margins([rows[i] for i in judged], w, ratio), y[judged])
        return pd.DataFrame([(w.astype(np.float32).tobytes(), a, b)], columns=["w", "a", "b"])

    return of


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights, ratios, slope and offset, from labelled documents that aren't held out."""
    known = columns(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    bound = 1_000_000
    part = min(bound, int(bound * FIT_ROWS / max(1, known.count())))
    d = columns(docs, doc_id="doc_id", text="text").where(~held_out(F.col("doc_id")))
    # Always by shuffle: labels grow with the documents, and the plan must not turn with their number.
    d = d.join(known.select("doc_id", "quality").hint("merge"), "doc_id")
    sampled = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(bound)) < part
    gathered = written(d.select("text", F.col("quality").cast("int").alias("quality"), sampled.alias("sampled")).mapInPandas(_gather, "quality int, features binary, bucket int, low long, high long"))
    counts = gathered.where("bucket >= 0").groupBy("bucket").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).toPandas()
    low, high = np.zeros(BUCKETS), np.zeros(BUCKETS)
    low[counts["bucket"]], high[counts["bucket"]] = counts["low"], counts["high"]
    zero = np.zeros(BUCKETS)
    if not low.any() or not high.any():
        return zero, zero, 1.0, float(np.log((high[0] + 1) / (low[0] + 1)))
    ratio = np.log((high + SMOOTH) / (high + SMOOTH).sum()) - np.log((low + SMOOTH) / (low + SMOOTH).sum())
    ratio[(low + high) == 0] = 0.0
    ratio[0] = 1.0
    fitted = gathered.where("quality >= 0").groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: _fit(ratio)(pdf), "w binary, a double, b double").first()
    if fitted is None:
        return zero, zero, 1.0, float(np.log((high[0] + 1) / (low[0] + 1)))
    return np.frombuffer(fitted["w"], np.float32).astype(float), ratio, fitted["a"], fitted["b"]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    w, ratio, a, b = train(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((w, ratio))

    def score(texts: pd.Series) -> pd.Series:
        w, ratio = model.value
        m = margins([features(t) for t in texts], w, ratio)
        return pd.Series(1 / (1 + np.exp(-np.clip(a * m + b, -35, 35))))

    d = columns(docs, doc_id="doc_id", text="text")
    scored = d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.pandas_udf(score, "double")("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
