"""Sharding, mixing and packing against brute force and their laws."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import mixing, packing, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)


ODD = [(1, "a b c", "x"), (2, "a b c", "x"), (2, "a b c", "x"), (None, None, None), (3, "", "y"), (4, "wörd " * 3000, "y"), (5, "z", None), (6, "\t\n", "x"), (None, "null id", "z")]


def brute_capacity(sizes, shards):
    """Smallest largest sum over all contiguous splits."""
    best = {0: 0}
    for _ in range(shards):
        nxt = dict(best)
        for i, cap in best.items():
            total = 0
            for j in range(i, len(sizes)):
                total += sizes[j]
                v = max(cap, total)
                if v < nxt.get(j + 1, 10**18):
                    nxt[j + 1] = v
        best = nxt
    return best[len(sizes)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=14), st.integers(1, 6))
def test_minimax_is_the_best_contiguous_split(sizes, shards):
    capacity, ends = sharding.minimax_ends(sizes, shards)
    assert capacity == brute_capacity(sizes, shards)
    assert ends[-1] == len(sizes) and len(ends) <= shards
    assert max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends)) == capacity


def test_sharding(spark):
    rows = [(i, f"text number {i} " * (i % 13), "s") for i in range(400)] + [(1000 + i, "hot copy", "s") for i in range(900)] + ODD
    got = sharding.minimax_shards(docs(spark, rows), 7).collect()
    assert len(got) == len(rows)
    by_shard, by_crc = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r.shard].append(r.slot)
        by_crc[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) <= set(range(7))
    assert all(len(s) == 1 for (crc, size), s in by_crc.items() if crc)
    texts = {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _ in rows}
    assert texts == {(r.doc_id, r.text_crc32, r.size) for r in got}
    assert sharding.minimax_shards(docs(spark, []), 7).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=14), st.integers(1, 6))
def test_even_cuts_keep_the_capacity(sizes, shards):
    capacity, _ = sharding.minimax_ends(sizes, shards)
    ends = sharding.even_ends(sizes, shards, capacity)
    assert len(ends) == shards and ends == sorted(ends) and ends[-1] == len(sizes)
    assert max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends)) == capacity


@pytest.mark.parametrize(("bits", "shards"), [(16, 7), (3, 7), (3, 40), (16, 1)])
def test_sharding_is_minimax_over_equal_texts(spark, monkeypatch, bits, shards):
    """Of whatever ranges it starts, and with columns of the operator's own names."""
    monkeypatch.setattr(sharding, "GROUP_BITS", bits)
    rng = np.random.default_rng(2)
    rows = [(i, f"text {i % 500} " * int(rng.pareto(1.2) * 3 % 700), "s") for i in range(900)] + ODD
    data = docs(spark, rows).selectExpr("*", "1 as size", "2 as ord", "3 as grp", "4 as part", "5 as shard", "6 as row")
    got = sharding.minimax_shards(data, shards).collect()
    groups = defaultdict(int)
    keyed = docs(spark, rows).select(F.xxhash64(F.col("text").isNull(), F.coalesce("text", F.lit(""))).alias("k"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n")).collect()
    for r in keyed:
        groups[r.k] += r.n
    capacity, _ = sharding.minimax_ends([groups[k] for k in sorted(groups)], shards)
    held = Counter()
    for r in got:
        held[r.shard] += r["size"]
    assert len(got) == len(rows) and max(held.values()) == capacity
    assert set(held) <= set(range(shards))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 5)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 200))
def test_subset_is_the_closest_from_below(items, budget):
    lengths, left = [a for a, _ in items], [b for _, b in items]
    take = mixing.fit_subset(lengths, left, budget)
    assert all(0 <= t <= n for t, n in zip(take, left, strict=True))
    sums = {0}
    for a, b in items:
        sums = {s + k * a for s in sums for k in range(b + 1)}
    assert sum(a * b for a, b in zip(lengths, take, strict=True)) == max(s for s in sums if s <= budget)


def test_large_budgets_are_met():
    rng = np.random.default_rng(1)
    lengths = sorted(set(rng.integers(1, 5000, 600).tolist()))
    counts = rng.integers(1, 90, len(lengths)).tolist()
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    for budget in (total // 3, total * 6 // 7, total // 7 + 5):
        take = mixing.fit_counts(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(take, counts, strict=True))
        assert sum(a * b for a, b in zip(lengths, take, strict=True)) == budget


def test_targets():
    assert mixing.cycle_weights(["b", None, "a", "é"]) == {"a": 1, "b": 2, "é": 3, None: 1}
    assert mixing.targets({"a": 10, "b": 10}, {"a": 1, "b": 3}) == {"a": 5.0, "b": 15.0}
    got = mixing.targets({"a": 100, "b": 2, "c": 6}, {"a": 1, "b": 2, "c": 3})
    assert got == {"b": 6.0, "c": 18.0, "a": 84.0}


def test_mixing(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 5}") for i in range(3000)] + [(5000 + i, "one two three", "s1") for i in range(1500)] + ODD
    data = docs(spark, rows)
    got = mixing.mix_sources(data).collect()
    assert len(got) == len(rows)
    taken, size = Counter(), Counter()
    for r in got:
        assert r.size == 0 or (r.taken % r.size == 0 and 0 <= r.taken <= 3 * r.size)
        taken[r.source] += r.taken
        size[r.source] += r.size
    aims = mixing.targets(dict(size), mixing.cycle_weights(list(size)))
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(aims[r.source])
    for s in ("s0", "s1", "s2", "s3", "s4"):
        assert abs(taken[s] - aims[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(data.repartition(3)).collect()))
    copies = Counter(r.doc_id for r in mixing.take_mix(data.where("doc_id >= 10")).collect())
    want = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(data.where("doc_id >= 10")).collect() if r.taken}
    assert {k: v for k, v in copies.items() if k in want} == want
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbBcéÉßİΣσ'sSt.,!<|endoftext|>  \n\t\x1c ́Ⅷ9漢"), max_size=60) | st.sampled_from(["a<|endoftext|>b", "<|EndOfText|> x<|startoftext|>", "It's. don't, i'll. ıſ. ǆ, x.. y,. İ. ﬁn.", "straße, Ångström. e\u0301a. naïve, a\u200db."]), max_size=6))
def test_words_give_the_ids_of_the_whole_text(texts):
    encode = packing._encoder(None).encode
    for text, ids in zip(texts, reference_ids(texts), strict=True):
        assert np.frombuffer(encode(text), "<u2").tolist() == ids[:-1]


def test_words_are_encoded_once_apart_from_their_marks(monkeypatch):
    """Words of every kind have the ids of the whole text; marks at their ends, however many, cost no encoding of the word again."""
    import public_tokenizers

    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    stems = ["straße", "cœur", "naïve", "ŉ", "ﬁne", "İstanbul", "ǆ", "ΑΣ", "ας", "don't", "it's", "a1b", "漢字", "e\u0301t", "é", "x", "theing", "Don'T", "ʰa", "ªb", "\u0130", "ⅷ", "x\u0338", "<|endoftext|>", "a<|b", "<|endoftext|>x"]
    tails = ["", ".", ",", "###", "***", "!!", "&&&", "'", "'s", "''", ".'", "-", "--a", ")", "…", "=", "=\u0338", "<", "<|", "|", "<|endoftext|>", "\\", '"', "$$$%"]
    texts = [x for s in stems for t in tails for x in (s + t, t + s, s + t + s, s.upper() + t)]
    texts += [" ".join(texts[k::37]) for k in range(37)] + [" ".join(x for x in texts[k::41] if "<|" not in x) for k in range(41)]
    for text, got, ids in zip(texts, enc.encode_all(texts), reference_ids(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == ids[:-1], text

    enc, seen = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    plain = enc._ids
    monkeypatch.setattr(enc, "_ids", lambda text: seen.append(text) or plain(text))
    enc.encode_all(["theing thorinsh theing. theing### thorinsh*** thorinsh!! theing&&& été été###"])
    assert not any("the" in t or "tho" in t for t in seen)


def test_distinct_words_are_looked_up_once():
    """The work in Python goes by distinct words, not by words; parts, odd ends, nulls and slices give the ids of the whole text."""
    import public_tokenizers

    class Counted(dict):
        gets = 0

        def get(self, *args):
            self.gets += 1
            return super().get(*args)

        def __getitem__(self, key):
            self.gets += 1
            return super().__getitem__(key)

    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    enc.known = Counted()
    texts = ["a bee  sea.\n" * 500, "", " ", "\x0b\x0cBEE\x1cx \t", "sea. <|endoftext|> BEE", "Sea.", "<|", "bee"] * 50
    for text, got, ids in zip(texts, enc.encode_all(texts), reference_ids(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == ids[:-1], text
    assert 0 < enc.known.gets < 500


def test_texts_in_parts(monkeypatch):
    """Parts end between texts, a text longer than a part is one; nulls are empty, and slices of arrays are read from where they begin."""
    monkeypatch.setattr(packing, "PART_BYTES", 40)
    texts = ["x" * 7, None, "one two " * 40, "", "é Ü " * 3, "<|endoftext|>", None, *["it's so."] * 20]
    column = pa.array(["before", None, *texts, "after"]).slice(2, len(texts))
    for kind in (pa.string(), pa.large_string()):
        parts = list(packing._encoder(None).encode_parts(column.cast(kind)))
        assert len(parts) > 5
        assert [k for k, _ in parts] == [0, *np.cumsum([len(p) for _, p in parts])[:-1]]
        got = [x for _, p in parts for x in p.to_pylist()]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [x[:-1] for x in reference_ids(texts)]
    assert list(packing._encoder(None).encode_parts(pa.array([], pa.string()))) == []


def test_words_known_before_the_cache_is_emptied(monkeypatch):
    """A text of more new words than the cache holds empties it; the words known before are learned again."""
    import public_tokenizers

    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["alpha beta", "alpha beta " + " ".join(f"gamma{chr(97 + k % 26) * (1 + k // 26)}" for k in range(200)), "beta."]
    for text, ids in zip(texts, reference_ids(texts), strict=True):
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == ids[:-1]


def test_deficits_carry_on():
    served = packing.deficit_rounds({"a": 1000, "b": 3000}, {"a": 0.25, "b": 0.75}, {"a": 10.0, "b": -10.0}, 400)
    assert [sum(b - a for _, a, b in w) for w in served] == [400] * 10
    assert dict((s, b - a) for s, a, b in served[0]) == {"a": 110, "b": 290}
    at = Counter()
    for k, window in enumerate(served[:-1], 1):
        for s, a, b in window:
            assert a == at[s]
            at[s] = b
        assert abs(at["a"] - min(1000, 10 + 100 * k)) <= 1


def test_packing(spark):
    rows = [(10 + i, " ".join(f"word{i % 7}x{k}" for k in range(i % 90)), f"s{i % 3}") for i in range(300)] + ODD
    got = packing.pack(docs(spark, rows), sequence=64, window=4, bucket_chars=40_000).collect()
    ids = reference_ids([t for _, t, _ in rows])
    want = Counter((i, len(x)) for (i, _, _), x in zip(rows, ids, strict=True))
    whole = defaultdict(int)
    for r in got:
        whole[r.doc_id, r.doc_tokens] += r.length
    assert {k: v * k[1] for k, v in want.items()} == dict(whole)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(64 - sum(n for _, n in p) for p in sequences.values()) < 64 * len({r.sequence_id >> 32 for r in got})
    by_id = {i: x for (i, _, _), x in zip(rows, ids, strict=True) if i not in (None, 2)}
    for r in got:
        if r.doc_id in by_id:
            piece = np.array(by_id[r.doc_id][r.start : r.start + r.length], "<u4")
            assert zlib.crc32(piece.tobytes()) == r.ids_crc32
    assert packing.pack(docs(spark, [])).count() == 0


def test_windows_hold_the_mixture(spark):
    rows = [(i, " ".join("abc" for _ in range(20 + i % 50)), "big" if i % 4 else "small") for i in range(2000)]
    got = packing.pack(docs(spark, rows), sequence=128, window=8, bucket_chars=60_000)
    total = {r.source: r.n for r in got.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    share = total["small"] / sum(total.values())
    per = got.groupBy(F.shiftright("sequence_id", 32).alias("bucket"), F.floor(F.expr("sequence_id & 4294967295") / 8).alias("w")).agg(
        F.sum("length").alias("n"), F.sum(F.when(F.col("source") == "small", F.col("length"))).alias("small")
    )
    full = [r for r in per.collect() if r.n == 8 * 128]
    assert len(full) > 20
    close = [abs((r.small or 0) / r.n - share) < 0.03 for r in full if r.w]
    assert np.mean(close) > 0.8
