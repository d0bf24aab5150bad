"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set holds the distinct shingles of its words (A-Z lower-cased); a
signature has COORDINATES MinHash values. Documents with equal sets form a
class, named by the number of one of its rows, and only classes are compared. A
class is posted under the (coordinate, value) pairs of its signature. Two
signatures that agree in at least `matches` coordinates share one within the
first COORDINATES - matches + 1 of either, in
any common order; the order puts frequent pairs last, so postings of passages
that many documents share are mostly skipped. Agreements are counted on the
whole signatures of pairs that share a posting; pairs above the threshold are
confirmed on the whole sets.

Hot lists aren't expanded into pairs at once. Two rounds compare every member
of a list with one hub of the list, another one in each list, the second with
members of other components only. What is left then are lists whose members lie
in several components. Of those, all pairs across components are compared: by a
join where the list is short, in blocks of members where it is long. A task that
compares blocks gives out only pairs whose signatures agree and whose bitmaps of
shingles differ in no more bits than the sets may in elements, which loses no
similar pair. So no pair that shares a posting and may connect two components is
left out, and a group of copies costs a number of comparisons that is linear in
it as long as the rounds connect it; the comparisons (not the rows) of what stays
apart, at similarities near the threshold, grow with the square of its number.

Confirming reads every set once per bucket of pairs: members of the same large
list are given common blocks, and pairs between two blocks share a bucket.

Recall: a pair at the similarity asked for agrees in fewer than `matches`
coordinates with a probability of MISS; more similar pairs are missed far less
often, and components hang together by many pairs.

Defined cases: a text without words has an empty set and is linked with
nothing; a text with fewer words than a shingle has its whole sequence as its
only shingle; very long texts have all their shingles; a null id shares its class's component but is never a component's
name, and stays only if no document with an id is like it, and then once; rows
repeating an id are judged each by its own text, so one row of a component
stays, the first by id and set, and two components may have the same smallest
id for a name; rows without words all stay; an empty table gives an empty
result; columns besides doc_id and text are not read by near_duplicates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, components, dropped, written

COORDINATES = 64
#: The probability with which a pair at the similarity asked for may agree in too few coordinates.
MISS = 1 / 4000
#: Lists above HEAVY members are put last; at most HEAVY_MOST such lists are told to the tasks, else the bound is raised.
HEAVY, HEAVY_MOST = 32, 1 << 17
SHORT_LIST, BLOCK, BUCKET_PAIRS = 64, 512, 2000
#: Bits of a bitmap of shingles.
BITS = 4096
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(77)
_ODD = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(1, 2**62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, in one pass over the text's bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    solid = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD[40])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mixed(h * _ODD[41] + words[i : n + i] * _ODD[i])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for k in range(0, len(shingles), 8192):
        best = np.minimum(best, ((shingles[k : k + 8192, None] * _FACTORS) >> np.uint64(32)).min(0).astype(np.uint32))
    return best


def _key(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _sign(width: int) -> Callable:
    def of(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            s = shingle_set(t, width)
            rows.append((len(s), _key(s.tobytes()), signature(s).tobytes()) if len(s) else (0, b"", b""))
        return pd.DataFrame(rows, columns=["n", "key", "sig"])

    return of


def _tokens(sigs: pd.Series) -> np.ndarray:
    """The posting of every coordinate of every signature, as 64-bit numbers."""
    s = np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), COORDINATES).astype(np.uint64)
    return _mixed(s + (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32))).view(np.int64)


def _all_tokens(sigs: pd.Series) -> pd.Series:
    return pd.Series(list(_tokens(sigs)))


def _order(sigs: pd.Series, heavy: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings of every signature, and the coordinates of its prefix of n."""
    t = _tokens(sigs)
    last = heavy[np.minimum(np.searchsorted(heavy, t), len(heavy) - 1)] == t if len(heavy) else np.zeros(t.shape, bool)
    return t, np.argsort(last, axis=1, kind="stable")[:, :n]


def _prefix(heavy: np.ndarray, n: int) -> Callable:
    def of(sigs: pd.Series) -> pd.DataFrame:
        t, order = _order(sigs, heavy, n)
        return pd.DataFrame({"token": list(np.take_along_axis(t, order, 1)), "coord": list(order.astype(np.int32))})

    return of


def _mask(heavy: np.ndarray, n: int) -> Callable:
    """The prefix's coordinates as bits."""

    def of(sigs: pd.Series) -> pd.Series:
        _, order = _order(sigs, heavy, n)
        return pd.Series(np.bitwise_or.reduce(np.left_shift(np.uint64(1), order.astype(np.uint64)), axis=1).view(np.int64))

    return of


def matches_for(percent: int, miss: float = MISS) -> int:
    """The most agreements that a pair of this similarity falls short of with a probability of `miss` at most."""
    p, tail = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        tail += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if tail > miss:
            return max(1, k)
    return COORDINATES


def _agreements(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), COORDINATES) for s in (a, b))
    return pd.Series((x == y).sum(1))


def _confirm(percent: int) -> Callable:
    def of(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        have = {i: np.frombuffer(s, np.uint64) for i, s in zip(sets["id"].tolist(), sets["shingles"].tolist(), strict=True)}
        keep = np.zeros(len(pairs), bool)
        for k, (a, b) in enumerate(zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True)):
            x, y = have[a], have[b]
            if len(x) > len(y):
                x, y = y, x
            if 100 * len(x) < percent * len(y):
                continue
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
        return pairs.loc[keep, ["a", "b"]]

    return of


def _bitmap(width: int) -> Callable:
    """The shingles' bits: two sets differ in as many elements as their bitmaps in bits, or in more."""

    def of(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            bits = np.zeros(BITS, bool)
            bits[shingle_set(t, width) % np.uint64(BITS)] = True
            out.append(np.packbits(bits).tobytes())
        return pd.Series(out)

    return of


def _across(matches: int, percent: int) -> Callable:
    """Pairs of a block of a long list, or of two, in different components, that agree often enough and whose sets can be similar enough.

    A pair counts in the list of the first coordinate that both prefixes hold
    and share, and in no other.
    """
    bits = np.left_shift(np.uint64(1), np.arange(COORDINATES, dtype=np.uint64))

    def of(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        s = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), COORDINATES)
        maps = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(pdf), BITS // 64)
        ids, comp, block, size = (pdf[c].to_numpy() for c in ("id", "comp", "block", "n"))
        mask, coord = pdf["mask"].to_numpy().view(np.uint64), int(pdf["coord"].iloc[0])
        earlier = np.uint64((1 << coord) - 1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        for at in left:
            hit = right[comp[right] != comp[at]]
            if i == j:
                hit = hit[ids[hit] > ids[at]]
            same = s[hit] == s[at]
            shared = np.where(same, bits, np.uint64(0)).sum(1, dtype=np.uint64) & mask[hit] & mask[at]
            hit = hit[(same.sum(1) >= matches) & ((shared & earlier) == 0)]
            # Similar sets differ in (100 - percent) of (100 + percent) of their sizes' sum at most.
            differ = np.bitwise_count(maps[hit] ^ maps[at]).sum(1)
            hit = hit[(100 + percent) * differ <= (100 - percent) * (size[hit] + size[at])]
            if len(hit):
                out.append(np.stack([np.minimum(ids[hit], ids[at]), np.maximum(ids[hit], ids[at])], 1))
        found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame(found, columns=["a", "b"])

    return of


class _Join:
    """The compared classes of one call; docs has (id, text), with an id for each row."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs, self.classes, self.width, self.percent, self.matches = docs, classes, width, percent, matches_for(percent)
        self.scratch: list[DataFrame] = []
        self.posts = self._post()
        self.lists = self.kept(self.posts.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id").bitwiseXOR(F.col("token"))).bitwiseXOR(F.col("token")).alias("hub")).where("n > 1"))
        self.rows = self.kept(self.posts.join(self.lists, "token"))
        biggest = self.rows.groupBy("id").agg(F.max(F.struct("n", "hub")).alias("top"))
        home = F.xxhash64("top.hub", F.pmod(F.xxhash64(F.lit(9), "id"), F.ceil(F.col("top.n") / 256)))
        self.homes = self.kept(biggest.select("id", home.alias("home")))

    def kept(self, df: DataFrame) -> DataFrame:
        """`df` written, to be dropped at the end."""
        self.scratch.append(written(df))
        return self.scratch[-1]

    def _post(self) -> DataFrame:
        n = COORDINATES - self.matches + 1
        every = self.classes.select(F.explode(F.pandas_udf(_all_tokens, "array<long>")("sig")).alias("token"))
        counts = self.kept(every.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY))
        bound = HEAVY
        while counts.where(F.col("n") > bound).count() > HEAVY_MOST:
            bound *= 4
        heavy = np.sort(np.array([r["token"] for r in counts.where(F.col("n") > bound).select("token").collect()], np.int64))
        self.mask = F.pandas_udf(_mask(heavy, n), "long")
        first = F.pandas_udf(_prefix(heavy, n), "token array<long>, coord array<int>")("sig")
        posts = self.classes.select("id", first.alias("p")).select("id", F.explode(F.arrays_zip("p.token", "p.coord")).alias("p"))
        return self.kept(posts.select("id", "p.token", "p.coord"))

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        sigs = self.classes.select("id", "sig")
        both = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
        return both.where(F.pandas_udf(_agreements, "long")("sig_a", "sig_b") >= self.matches).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough.

        Sets are made again from the texts of the documents in question, so
        no set of any other document is kept or moved.
        """
        homes = self.homes
        keyed = pairs.join(homes.toDF("a", "home_a"), "a").join(homes.toDF("b", "home_b"), "b")
        keyed = self.kept(keyed.select("a", "b", F.xxhash64(F.least("home_a", "home_b"), F.greatest("home_a", "home_b")).alias("home")))
        buckets = max(12, keyed.count() // BUCKET_PAIRS)
        keyed = keyed.select("a", "b", F.pmod("home", F.lit(buckets)).alias("bucket"))
        needed = self.kept(keyed.select(F.col("bucket").alias("at"), F.explode(F.array("a", "b")).alias("id")).distinct())
        if needed.count() <= BROADCAST_IDS:
            needed = F.broadcast(needed)
        width = self.width
        sets = F.pandas_udf(lambda t: pd.Series([shingle_set(x, width).tobytes() for x in t]), "binary")
        needed = self.docs.join(needed, "id").select("at", "id", sets("text").alias("shingles"))
        return self.kept(keyed.groupBy("bucket").cogroup(needed.groupBy("at")).applyInPandas(_confirm(self.percent), "a long, b long"))

    def placed(self, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(token, coord, id, n, comp) of all lists, and those that reach several components with another hub."""
        rows = self.rows.join(comps.toDF("id", "comp"), "id", "left").select("token", "coord", "id", "n", F.coalesce("comp", "id").alias("comp"))
        rows = self.kept(rows)
        top = F.max(F.struct(F.xxhash64(F.lit(1), "id").alias("h"), "id", "comp"))
        lists = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), top.alias("top")).where("low <> high")
        return rows, self.kept(lists.select("token", F.col("top.id").alias("hub"), F.col("top.comp").alias("hub_comp")))

    def rest(self, rows: DataFrame, lists: DataFrame) -> DataFrame:
        """All agreeing pairs across components."""
        open_ = rows.join(lists.select("token"), "token")
        short = open_.where(F.col("n") <= SHORT_LIST)
        other = short.select("token", F.col("id").alias("b"), F.col("comp").alias("comp_b"))
        near = short.select("token", F.col("id").alias("a"), "comp").join(other, "token").where("a < b and comp <> comp_b").select("a", "b").distinct()
        blocks = F.ceil(F.col("n") / BLOCK)
        long_ = self.kept(open_.where(F.col("n") > SHORT_LIST)).select("token", "coord", "id", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit(2), "id"), blocks).alias("block"))
        dealt = long_.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select(
            "token", "coord", "id", "comp", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
        ids = self.kept(long_.select("id").distinct())
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        maps = self.docs.join(ids, "id").select("id", F.pandas_udf(_bitmap(self.width), "binary")("text").alias("bits"))
        known = self.kept(self.classes.join(maps, "id").select("id", "sig", "n", "bits", self.mask("sig").alias("mask")))
        far = dealt.join(known, "id").groupBy("token", "i", "j").applyInPandas(_across(self.matches, self.percent), "a long, b long")
        return self.agreeing(near).unionByName(far).distinct()

    def components(self) -> DataFrame:
        star = self.rows.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        edges = self.confirmed(self.agreeing(star))
        rows, lists = self.placed(components(edges))
        again = rows.join(lists, "token").where("comp <> hub_comp").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        edges = self.kept(edges.unionByName(self.confirmed(self.agreeing(again))))
        rows, lists = self.placed(components(edges))
        found = written(components(edges.unionByName(self.confirmed(self.rest(rows, lists)))))
        dropped(*self.scratch)
        return found


def _judged(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """`docs`, written with a number for each row, and (row, doc_id, n_shingles, key, component_id, kept) of all rows."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    d = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    signed = written(d.select("row", "doc_id", F.pandas_udf(_sign(width), "n long, key binary, sig binary")("text").alias("s")).select("row", "doc_id", "s.*"))
    # The first row of a class, as of a component: by id, those without one last, set and number.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "row")).alias("first")
    members = signed.where("n > 0").groupBy("key").agg(F.min("row").alias("id"), F.max("sig").alias("sig"), F.max("n").alias("n"), first)
    classes = written(members)
    comps = _Join(d.select(F.col("row").alias("id"), "text"), classes.select("id", "sig", "n"), width, percent).components()
    placed = classes.join(comps, "id", "left").select("key", "first", F.coalesce("component", "id").alias("component"))
    heads = placed.groupBy("component").agg(F.min("first").alias("head"))
    named = placed.join(heads, "component").select("key", "head")
    found = signed.join(named, "key", "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), "key", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        F.coalesce(F.col("row") == F.col("head.row"), F.lit(True)).alias("kept"))
    return rows, found


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document.

    width: words in a shingle; percent: least similarity of linked documents.
    """
    _, found = _judged(columns(docs, doc_id="doc_id", text="text"), width, percent)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, one_per_id: bool = True) -> DataFrame:
    """`docs` without the rows that aren't kept.

    one_per_id: of rows repeating an id only one stays, the first by its set; else all different texts under an id stay.
    """
    rows, found = _judged(docs, width, percent)
    kept = found.where("kept")
    if one_per_id:
        again = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("key", "row")).alias("first"))
        kept = kept.where("doc_id is null").select("row").unionByName(again.select("first.row"))
    return rows.join(kept.select("row"), "row", "left_semi").select("doc.*")
