"""URL filtering against a list of canonical URLs: a blocked Bloom filter, then an exact hash join.

A canonical URL is a host and a path; it covers its host with all subdomains
and every path that starts with its own. A page's candidates are its host's
suffixes at label borders, each with the path prefixes of the lengths that
occur in the list. Candidates are tested against a Bloom filter made of 64-bit
blocks: one hash picks the block, four bits of another must be set in it, so a
test touches a single word. What passes is joined exactly with the list, which
removes the filter's false positives; it has no false negatives. The longest
entry that fits decides.

The filter has at least 16 bits for each entry. Its words are kept RANGE to a row
and tested where the pages are read: they are broadcast up to FILTER_ROWS rows,
which is 64 MB or a list of 33 million entries, and only candidates that pass are
moved for the exact join. A list of more is dealt by the ranges of its filter. The
list itself is broadcast up to BROADCAST_ROWS entries and else joined by key.
Distinct (host, path) pairs are judged once.

Defined cases: a null url or one without :// has an empty host and path and
meets no entry; an empty path meets no entry, since entries' paths start with /;
rows that repeat a page_id are judged each by its own url; entries listed twice
with both verdicts block; an empty list or table is no special case; columns
besides page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, columns

ADDRESS = r"://([^/?#]*)([^?#]*)"
BROADCAST_ROWS = 1 << 16
#: Words in a row of the filter, and rows up to which it is broadcast.
RANGE, FILTER_ROWS = 1024, 1 << 13
BITS_PER_ENTRY = 16

#: The rules, each a host, a path and a verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Unwanted sites, for any of the public example domains.
UNWANTED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED = [(f"{name}.example.{top}", "/", "block") for name in UNWANTED for top in ("com", "net", "org")]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, ADDRESS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def mask_of(key: str) -> Column:
    """Four bits of a word."""
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64('bits', {key}), {k}) & 63 as int))" for k in (0, 6, 12, 18))).alias("mask")


def bloom_words(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of a column `key`: (range, words), RANGE words in a row; ranges without a key have none."""
    words = keys.select(block_of("key", blocks), mask_of("key")).groupBy("block").agg(F.bit_or("mask").alias("word"))
    by_place = F.map_from_entries(F.collect_list(F.struct((F.col("block") % RANGE).alias("at"), "word")))  # RANGE of them at most
    rows = words.groupBy(F.floor(F.col("block") / RANGE).alias("range")).agg(by_place.alias("m"))
    return rows.select("range", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(RANGE - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def candidates(lengths: list[int]) -> Column:
    """Keys a (host, path) can meet: suffixes of the host with prefixes of the path."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def matched(addresses: DataFrame, listed: DataFrame) -> DataFrame:
    """(host, path, key, verdict) of the longest listed entry that fits; listed: (host, path, verdict)."""
    entries = listed.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict").groupBy("key", "n").agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r["n"] for r in entries.select("n").distinct().collect())  # no more than the longest path has characters
    count = entries.count()
    blocks = 64
    while blocks * 64 < BITS_PER_ENTRY * count:
        blocks *= 2
    few = F.broadcast if count <= BROADCAST_ROWS else lambda df: df
    short = F.broadcast if blocks // RANGE <= FILTER_ROWS else lambda df: df
    if not lengths:
        lengths = [0]
    keys = addresses.select("host", "path", F.explode(candidates(lengths)).alias("key"))
    block = F.col("block")
    possible = (
        keys.select("*", block_of("key", blocks), mask_of("key")).withColumn("range", F.floor(block / RANGE))
        .join(short(bloom_words(entries, blocks)), "range")
        .where(F.get("words", (block % RANGE).cast("int")).bitwiseAND(F.col("mask")) == F.col("mask")).select("host", "path", "key")
    )
    hits = possible.join(few(entries.select("key", "verdict")), "key")
    best = F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best")
    return hits.groupBy("host", "path").agg(best).select("host", "path", "best.key", "best.verdict")


def as_list(spark, entries: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of (host, path, verdict) as a DataFrame of literals."""
    of = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in entries))
    return spark.range(1).select(F.explode(of).alias("e")).select("e.*")


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: the longest rule's, else the longest listed entry's, else `default`."""
    d = columns(pages, page_id="page_id", url="url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    addresses = d.select("host", "path").where("host <> '' or path <> ''").distinct()
    by_rule = matched(addresses, rules).select("host", "path", F.col("key").alias("rule"), F.col("verdict").alias("rule_verdict"))
    by_list = matched(addresses, listed).select("host", "path", F.col("verdict").alias("list_verdict"))
    judged = by_rule.join(by_list, ["host", "path"], "full")
    return d.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "list_verdict", F.lit(default)).alias("verdict"))


def _values(entries: list[tuple[str, str, str]]) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in entries)


ORACLE = f"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '{ADDRESS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path
  FROM pages),
rules(h, q, v) AS (VALUES {_values(RULES)}),
listed(h, q, v) AS (VALUES {_values(LISTED)})
SELECT page_id, host, path,
  (SELECT arg_max(h || q, length(h || q)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
  coalesce(
    (SELECT arg_max(v, length(h || q)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)),
    (SELECT arg_max(v, length(h || q)) FROM listed WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)),
    'allow') AS verdict
FROM p
"""
