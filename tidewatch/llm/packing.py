"""Mixture-controlled packing into fixed-length token sequences.

Documents are tokenized once and dealt by a hash into buckets, each holding
about the same share of every source. In a bucket the documents of a source
form a queue. A window is a whole number of sequences; per window each source
earns its target share of the window's tokens on top of its deficit, and the
round serves every queue up to its deficit, cutting the last document where the
deficit is used up. What rounding or a dry queue leaves over goes to the queue
with the largest deficit. Deficits carry on to the next window, and from bucket
to bucket: a bucket starts with what all buckets before it owe each source,
a running sum over the bucket totals. Only a bucket's last sequence is padded.

The tokenizer works on words: white space parts its pre-tokens, so the ids of a
text are the ids of its white-space separated words in a row. Texts stay in Arrow
arrays, a few MB at a time: their words are numbered, each distinct one is looked
up once in a bounded per-worker cache, and the ids are gathered by number. Only new
words are encoded: those of letters by the tokenizer's model alone, without its
normalizer and splitter, which leave them as they are; the marks that end a word
apart from it.

Defined cases: a null or empty text is the end id alone; null and repeated ids
are documents of their own, in the order of the hash; a very long text is cut into
as many pieces as it needs, all its ids kept; a null source is a queue
of its own; an empty table gives an empty result; columns besides doc_id, text
and source are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, written

SEQUENCE = 2048
WINDOW_SEQUENCES = 64
END_ID = 1
#: Characters of text in a bucket: at least, and at most where there would be more than BUCKETS.
BUCKET_CHARS, BUCKET_CHARS_MOST, BUCKETS = 2_000_000, 64_000_000, 100_000
CACHE_WORDS = 1_500_000
#: Words encoded in one call; bytes of texts, or one longer text, whose words are numbered together.
PART_WORDS, PART_BYTES = 500, 8_000_000
#: ASCII white space, and the tokenizer's own lower-casing of A-Z.
WHITE, LOWER = b" \t\n\r\x0b\x0c", bytes(range(256)).lower()
IS_WHITE = np.isin(np.arange(256), list(WHITE))
#: Marks that after a letter are a pre-token of their own; an apostrophe may begin one with letters.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters that stand for bytes in the tokenizer's words, where they aren't those of the same number.
BYTE_NAMES = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174))}
TOKENS = "doc_id string, source string, key long, bucket long, ids binary, n long"
PIECES = "doc_id string, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of texts, as the tokenizer gives them for the whole text, without special tokens added."""

    SEPARATOR = "<|endoftext|>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator_id = self.tokenizer.token_to_id(self.SEPARATOR)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.known: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")

    def _separated(self, words: list[bytes]) -> None:
        """Encodes words with the separator, which is a token of its own, between them."""
        for k in range(0, len(words), PART_WORDS):
            part = words[k : k + PART_WORDS]
            ids = self._ids(self.SEPARATOR.join([w.decode() for w in part]))
            ends = [*np.flatnonzero(ids == self.separator_id).tolist(), len(ids)]
            start = 0
            for w, end in zip(part, ends, strict=True):
                self.known[w] = ids[start:end].tobytes()
                start = end + 1

    def _lettered(self, words: list[bytes]) -> None:
        """Encodes words of lower-case letters only, each a single pre-token, as the tokenizer's model does."""
        tokenize = self.tokenizer.model.tokenize
        for w in words:
            name = w.decode() if w.isascii() else w.decode("latin-1").translate(BYTE_NAMES)
            ids = [t.id for t in tokenize(name)]
            self.known[w] = struct.pack(f"<{len(ids)}H", *ids)

    def _learn(self, words: list[bytes]) -> None:
        need, ended = set(), []
        for w in words:
            if w.isalpha():
                need.add(w)
            elif b"<|" in w:  # may hold the separator itself
                self.known[w] = self._ids(w.decode()).tobytes()
            elif (stem := w.rstrip(MARKS)) and stem != w and 97 <= stem[-1] <= 122:
                ended.append((w, stem, w[len(stem) :]))
                need.update(ended[-1][1:])
            else:
                need.add(w)
        lettered, other = [], []
        for w in need.difference(self.known):
            t = w.decode()
            (lettered if t.isalpha() and t.islower() and is_normalized("NFC", t) else other).append(w)
        self._lettered(lettered)
        self._separated(other)
        for w, stem, tail in ended:
            self.known[w] = self.known[stem] + self.known[tail]

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not new:
            return found
        if len(self.known) + 3 * len(new) > CACHE_WORDS:
            self.known.clear()
            new = words
        self._learn(new)
        return list(map(self.known.__getitem__, words)) if new is words else [self.known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def _encoded(self, raw: bytes, offsets: np.ndarray) -> pa.Array:
        """The ids of texts that lie in a row, each from one offset to the next."""
        white = np.flatnonzero(IS_WHITE[np.frombuffer(raw, "u1")])
        if b"<|" in raw:  # marked texts keep their case, which the tokenizer's special tokens heed
            texts = [raw[a:b] for a, b in pairwise(offsets.tolist())]
            data = b"".join([t.translate(None if b"<|" in t else LOWER, WHITE) for t in texts])
        else:
            data = raw.translate(LOWER, WHITE)
        # A word begins with its text or behind a white-space character, and may be empty; the characters themselves are gone from data.
        before = np.searchsorted(white, offsets)
        firsts = (before + np.arange(len(offsets))).astype("<i4")
        starts, inner = np.empty(firsts[-1] + 1, "<i4"), np.ones(firsts[-1] + 1, bool)
        inner[firsts] = False
        starts[inner] = white - np.arange(len(white))
        starts[firsts] = offsets - before
        words = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        ends, distinct = views(words.dictionary)
        distinct = bytes(distinct)
        ids = self._ids_of([distinct[a:b] for a, b in pairwise(ends.tolist())])
        ends = np.zeros(len(ids) + 1, "<i4")
        np.cumsum(np.fromiter(map(len, ids), "<i4", len(ids)), out=ends[1:])
        ids = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(ids))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(firsts), ids.take(words.indices)), b"")

    def encode_parts(self, texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """The ids of texts as little-endian 16-bit numbers, a part of the texts after the other: the index of its first text, its ids."""
        k, (offsets, _) = 0, views(texts)
        while k < len(texts):
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PART_BYTES, "right")) - 1)
            at, raw = views(texts.slice(k, end - k).fill_null(""))
            yield k, self._encoded(bytes(raw), at)
            k = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [x for _, part in self.encode_parts(pa.array(texts, pa.string())) for x in part.to_pylist()]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def views(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each text begins and the last one ends, and the bytes of all."""
    if not len(texts):
        return np.zeros(1, "<i8"), memoryview(b"")
    large = texts.cast(pa.large_binary())
    _, offsets, data = large.buffers()
    offsets = np.frombuffer(offsets, "<i8")[large.offset : large.offset + len(large) + 1]
    return offsets - offsets[0], memoryview(data or b"")[offsets[0] : offsets[-1]]


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordEncoder(path)


def _tokenize(path: str | None):
    end = pa.scalar(np.array([END_ID], "<u2").tobytes(), pa.binary())

    def of(batches):
        encode_parts = _encoder(path).encode_parts
        for batch in batches:
            for k, ids in encode_parts(batch.column("text")):
                ids = pc.binary_join_element_wise(ids, end, b"")
                kept = [batch.column(name).slice(k, len(ids)) for name in ("doc_id", "source", "key", "bucket")]
                yield pa.RecordBatch.from_arrays([*kept, ids, pc.divide(pc.binary_length(ids), 2).cast(pa.int64())], TOKENS.replace(",", "").split()[::2])

    return of


def deficit_rounds(sizes: dict, shares: dict, deficits: dict, window: int) -> list[list[tuple]]:
    """For each window the tokens (source, from, to) that each queue gives.

    sizes: tokens per queue; shares: target proportions; deficits: owed at the start.
    """
    at, owed, out = dict.fromkeys(sizes, 0), {s: deficits.get(s, 0.0) for s in sizes}, []
    left = sum(sizes.values())
    while left:
        room = min(window, left)
        left -= room
        live = [s for s in sizes if at[s] < sizes[s]]
        whole = sum(shares[s] for s in live) or 1.0
        gives = dict.fromkeys(live, 0)
        for s in live:
            owed[s] += room * shares[s] / whole
        for s in live:
            gives[s] = max(0, min(sizes[s] - at[s], int(owed[s]), room))
            room -= gives[s]
        for s in sorted(live, key=lambda s: -(owed[s] - gives[s])):
            more = min(room, sizes[s] - at[s] - gives[s])
            gives[s] += more
            room -= more
        served = []
        for s, n in gives.items():
            if n:
                served.append((s, at[s], at[s] + n))
                at[s] += n
                owed[s] -= n
        out.append(served)
    return out


def pack_bucket(bucket: int, docs: pd.DataFrame, owed: pd.DataFrame, sequence: int, window: int) -> pd.DataFrame:
    docs = docs.sort_values(["key", "doc_id"], kind="stable")
    queues = {s: d for s, d in docs.groupby(docs["source"].fillna("\0null"), sort=True)}
    owed = owed.assign(source=owed["source"].fillna("\0null")).set_index("source")
    sizes = {s: int(q["n"].sum()) for s, q in queues.items()}
    places = {s: [(e - n, e, i, n, b) for e, i, n, b in zip(np.cumsum(q["n"]).tolist(), q["doc_id"].tolist(), q["n"].tolist(), q["ids"].tolist(), strict=True)] for s, q in queues.items()}
    nexts = dict.fromkeys(queues, 0)
    rows, at = [], 0
    for served in deficit_rounds(sizes, owed["share"].to_dict(), owed["owed"].to_dict(), window * sequence):
        for s, a, b in served:
            while a < b:
                begin, end, doc, n, ids = places[s][nexts[s]]
                stop = min(b, end, a + sequence - at % sequence)
                piece = np.frombuffer(ids, "<u2", stop - a, 2 * (a - begin)).astype("<u4")
                rows.append((doc, None if s == "\0null" else s, a - begin, stop - a, zlib.crc32(piece.tobytes()), n, (bucket << 32) + at // sequence, at % sequence))
                at += stop - a
                a = stop
                nexts[s] += a == end
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, sequence: int = SEQUENCE, window: int = WINDOW_SEQUENCES, vocabulary: str | None = None, seed: int = 5, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Pieces of documents in sequences of at most `sequence` tokens.

    doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset;
    vocabulary: path of the tokenizer's file, on all executors.
    """
    d = columns(docs, doc_id="doc_id", text="text", source="source")
    chars = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // min(BUCKET_CHARS_MOST, max(bucket_chars, chars // BUCKETS))))
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    dealt = d.select(F.col("doc_id").cast("string").alias("doc_id"), "source", key.alias("key"), F.pmod(key, F.lit(buckets)).alias("bucket"), "text")
    tokens = written(dealt.mapInArrow(_tokenize(vocabulary), TOKENS))

    totals = written(tokens.groupBy("bucket", "source").agg(F.sum("n").alias("n")))
    whole = totals.agg(F.sum("n")).first()[0] or 1
    # One narrow row per bucket and source. The running sum over all buckets is of one row per bucket.
    per_bucket = totals.groupBy("bucket").agg(F.sum("n").alias("all_n"))
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per_bucket = per_bucket.select("bucket", F.coalesce(F.sum("all_n").over(earlier), F.lit(0)).alias("all_before"))
    per_source = totals.groupBy(F.struct("source").alias("s")).agg(F.sum("n").alias("source_n"))
    shares = per_source.select("s", (F.col("source_n") / F.lit(float(whole))).alias("share"))
    of_source = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    owed = (
        totals.withColumn("s", F.struct("source"))
        .withColumn("before", F.coalesce(F.sum("n").over(of_source), F.lit(0)))
        .join(shares, "s").join(per_bucket, "bucket")
        .select("bucket", "source", "share", (F.col("share") * F.col("all_before") - F.col("before")).alias("owed"))
    )

    def of(bucket, docs_of, owed_of):
        return pack_bucket(int(bucket[0]), docs_of, owed_of, sequence, window)

    # Ids travel as text, since pandas would turn long ids with nulls among them into floats.
    packed = tokens.groupBy("bucket").cogroup(owed.groupBy("bucket")).applyInPandas(of, PIECES)
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
