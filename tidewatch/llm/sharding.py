"""Minimax contiguous sharding.

Texts are put in the order of a 64-bit hash; the ordered atomic groups are the
equal texts, which share the hash. Their byte sizes are summed where the data
lies, and the driver sees sums of ranges of the hash only: of 2^16 at first. It
finds by binary search the smallest capacity for which greedy filling needs no
more than `shards` shards, taking ranges for groups; then those ranges in which
greedy filling may cut at any capacity still possible are split up, and so on
until each of them is a single group. So the capacity is the minimax over the
equal texts, though the driver never holds more than some tens of thousands of
sums at a time. Cuts are then moved, within that capacity, to where they part
the bytes most evenly; else the last shard would get what greedy filling leaves.

Slots count up from 0 in each shard without a gap: the counts of a shard's
earlier ranges (a running sum over the bounded table of ranges) plus the row
number within the range. A range with many rows is dealt into parts by a hash of
doc_id first, so that numbering a text repeated in a third of all rows is spread
over many tasks; rows that repeat a doc_id as well are dealt by a hash of the
partition and place in it where they were read.

Defined cases: a null text has size 16, checksum 0 and is a group of its own;
null ids and repeated rows get a slot each (which of two identical rows gets
which is open); shards can stay empty if there are fewer groups than shards or
one group outweighs the rest; a very long text counts with its bytes and is a
group like any other; an empty table gives an empty result; only doc_id and text
are read, whatever other columns are called.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, written

GROUP_BITS = 16
OVERHEAD = 16
#: Rows that one part of a group holds, and parts that all rows make at most.
PART_ROWS, PARTS = 256, 65536


def greedy_ends(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Index after the last group of each shard, filling each to `capacity`; None if `shards` don't hold all. sums: running sums from 0."""
    ends, at = [], 0
    while at < len(sums) - 1:
        if len(ends) == shards:
            return None
        end = bisect_right(sums, sums[at] + capacity) - 1
        if end <= at:
            return None
        ends.append(at := end)
    return ends


def minimax_ends(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and where greedy filling to it cuts the ordered sizes."""
    sums = [0, *accumulate(sizes)]
    low, high = max([0, *sizes, -(-sums[-1] // shards)]), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy_ends(sums, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, greedy_ends(sums, low, shards) or []


def even_ends(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Where to cut the ordered sizes into `shards` parts of at most `capacity`, as near to equal parts as that allows."""
    sums = [0, *accumulate(sizes)]
    first = [len(sizes)]  # from the back: the first place that the later shards can hold all after
    for _ in range(shards - 1):
        first.append(bisect_left(sums, sums[first[-1]] - capacity))
    ends, at = [], 0
    for k, least in zip(range(1, shards), first[-1:0:-1], strict=True):
        most = bisect_right(sums, sums[at] + capacity) - 1
        ideal = sums[-1] * k / shards
        near = bisect_left(sums, ideal)
        if near > 0 and (near == len(sums) or ideal - sums[near - 1] <= sums[near] - ideal):
            near -= 1
        ends.append(at := max(at, least, min(most, near)))
    return [*ends, len(sizes)]


class _Ranges:
    """Ordered ranges of the hash: (low, bits, bytes, rows, atomic); a range has 2^bits places from low on."""

    def __init__(self, digest: DataFrame):
        self.digest = digest
        self.found = self._sums(64 - GROUP_BITS, None)

    def _sums(self, bits: int, within: list[tuple] | None) -> list[tuple]:
        rows = self.digest
        if within is not None:  # at most 2^16 keys
            old = within[0][1]
            keys = self.digest.sparkSession.createDataFrame([(x[0] >> old,) for x in within], "key long")
            rows = rows.join(F.broadcast(keys), F.shiftright("ord", old) == F.col("key"), "left_semi")
        sums = rows.groupBy(F.shiftright("ord", bits).alias("at")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("ord").alias("least"), F.max("ord").alias("most"))
        return sorted((r["at"] << bits, bits, r["bytes"], r["n"], r["least"] == r["most"]) for r in sums.collect())

    def split(self, which: set[int]) -> None:
        """Splits the ranges at these places of the list, those with most places first, to 2^16 sums at most."""
        bits = max(self.found[k][1] for k in which)
        some = [self.found[k] for k in sorted(which) if self.found[k][1] == bits][: 1 << GROUP_BITS - 1]
        step = min(bits, max(1, GROUP_BITS - len(some).bit_length()))
        gone = {x[0] for x in some}
        self.found = sorted([x for x in self.found if x[1] != bits or x[0] not in gone] + self._sums(bits - step, some))


def capacity_and_ranges(digest: DataFrame, shards: int) -> tuple[int, list[tuple]]:
    """The minimax capacity over equal texts, and ranges that allow cuts for it; digest: (ord, size)."""
    ranges = _Ranges(digest)
    while True:
        sizes = [x[2] for x in ranges.found]
        high, _ = minimax_ends(sizes, shards)
        sums, n = [0, *accumulate(sizes)], len(sizes)
        low = max([-(-sums[-1] // shards), 0, *(x[2] for x in ranges.found if x[4])])
        open_, left, right = set(), 0, 0
        for _ in range(shards):
            # The first range that a shard's end can lie in, at the least capacity, and the last, at the most and if ranges could be cut anywhere.
            left = max(left, bisect_right(sums, sums[left] + low) - 1) if left < n else n
            right = min(sums[-1], right + high)
            last = min(n - 1, bisect_left(sums, right))
            open_ |= {k for k in range(left, last + 1) if not ranges.found[k][4]}
        if not open_ or low == high:
            return high, ranges.found
        ranges.split(open_)


def minimax_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each document."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    d = columns(docs, doc_id="doc_id", text="text")
    text = F.coalesce("text", F.lit(""))
    place = F.xxhash64(F.col("text").isNull(), text)
    digest = written(
        d.select(
            "doc_id",
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            place.alias("ord"),
            F.xxhash64(F.lit(3), "doc_id", F.monotonically_increasing_id()).alias("row"),
        )
    )
    capacity, found = capacity_and_ranges(digest.select("ord", "size"), shards)
    ends = even_ends([x[2] for x in found], shards, capacity) if found else []
    part_rows = max(PART_ROWS, sum(x[3] for x in found) // PARTS)
    # A cut is the first hash of a shard; an empty shard's is the next one's.
    shard: Column = sum(((F.col("ord") >= found[e][0]).cast("int") for e in ends[:-1] if e < len(found)), F.lit(0))

    placed = digest.withColumn("shard", shard).withColumn("grp", F.shiftright("ord", 64 - GROUP_BITS))
    # At most 2^16 rows and one more for each shard.
    parts = placed.groupBy("shard", "grp").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts"))
    dealt = written(placed.join(F.broadcast(parts), ["shard", "grp"]).withColumn("part", F.pmod("row", "parts")))
    # At most PARTS rows more than that.
    order = W.partitionBy("shard").orderBy("grp", "part").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy("shard", "grp", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "grp", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("shard", "grp", "part").orderBy("ord", "doc_id"))
    return (
        dealt.withColumn("rank", rank).join(F.broadcast(before), ["shard", "grp", "part"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))
    )
