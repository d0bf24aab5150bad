"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

A line's set holds its character shingles: the WIDTH characters from every
character on, or the whole of a shorter line. Lines are similar if the Jaccard
similarity of their sets is at least `similarity`. The signature of a line has
COORDINATES MinHash values: of the 64-bit hashes of its shingles, rotated by one
of four distances, the one nearest by exclusive-or to a constant of the
coordinate. Every ROWS coordinates make a band: a pair shares one of them at
similarity 0.8 with a probability of 0.986, at 0.85 of 0.997.

Equal lines are one from the start. In each band's list every line is compared
with two hubs of the list; what they link becomes components. Lists that still
reach several components are open, and in these all pairs across components
are verified by a join that gives out none but similar ones. Before lines are
compared in full, bitmaps of their sets rule out pairs that differ in too many
bits. A bit tells whether an odd number of the set's shingles fall on it, so what
two sets share leaves no difference however long they are; that loses nothing, as
each shingle that only one of them has turns one bit. Verification is exact: the
sets are made again from the lines. Linked lines are united by distributed union-find; of a component
the first line, by doc_id and place, stays.

The time of the comparison across components grows with the square of a list's
lines that stay apart though they share a band, which takes lines of a
similarity near the threshold; what moves and what is given out does not.

Lines and shingles are told apart by 64-bit hashes: among 10^10 different lines
about three pairs are taken for equal.

Defined cases: lines are what newlines part; a line without a word is neither
compared nor dropped; a null text has no lines; a null doc_id comes first in
order; rows that repeat a doc_id and its text share their fate; very long lines
are lines like any other; an empty table gives an empty result; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, components, dropped, written

WIDTH = 10
ROWS, TURNS = 3, 4
#: The coordinates of each band: more bands take more rows, more coordinates more time for each shingle.
BANDS = [list(range(c, c + ROWS)) for c in range(0, 18, ROWS)]
COORDINATES = ROWS * len(BANDS)
#: A band's low bits are its place in BANDS, so lists are told apart by one number.
PLACE = 7
#: Bands whose lists have their hubs by the same rule.
HUB_BANDS = 2
#: Shingles that one row of the exploded lines holds when they are signed, and when they are mapped: powers of two.
CHUNK, MAP_CHUNK = 16, 8
#: Words of a bitmap.
WORDS = 16
MAP = ["room", *(f"x{w}" for w in range(WORDS))]
#: Rows up to which a table of ids, or of lists, is broadcast: 16 MB at most.
BROADCAST_IDS, BROADCAST_LISTS = 1_000_000, 200_000
#: Line numbers in a place, and the document number of a null id, before all others.
LINES, NO_ID = 1 << 31, -(1 << 63) - 1
#: The same where all document numbers are nearer to 0, so that places are longs.
NARROW_NO_ID = -(1 << 32)

_RNG = random.Random(40)
#: A constant for each coordinate; those of one rotation differ in their leading bits, so they lead to different shingles.
NEAR = [((c // TURNS * 16 * TURNS // COORDINATES << 60 | _RNG.getrandbits(60)) ^ 1 << 63) - (1 << 63) for c in range(COORDINATES)]


def line_id(line: Column) -> Column:
    return F.xxhash64(line)


def _wide(line: Column) -> Column:
    """Whether a line has characters that take two units of UTF-16, and so three bytes of UTF-8 beside the first."""
    return (F.octet_length(line) >= F.length(line) + 3) & (F.octet_length(_encoded(line, False)) > 2 * F.length(line))


def _encoded(line: Column, wide: bool) -> Column:
    """A line in `_unit(wide)` bytes a character, where a place is found at once."""
    return F.encode(line, "UTF-32" if wide else "UTF-16BE")


def _unit(wide: bool) -> int:
    return 4 if wide else 2


def _last(e: Column, wide: bool) -> Column:
    """The place of the last shingle in an encoded line."""
    return F.greatest(F.octet_length(e) - (_unit(wide) * WIDTH - 1), F.lit(1))


def _hash(e: Column, place: Column, wide: bool) -> Column:
    """The hash of a shingle, by its UTF-16 in either kind of line."""
    cut = F.substring(e, place, F.lit(_unit(wide) * WIDTH))
    return F.xxhash64(F.encode(F.decode(cut, "UTF-32"), "UTF-16BE") if wide else cut)


def shingles(line: Column, which: tuple[bool, ...] = (False, True)) -> Column:
    """The hashes of a line's character shingles, some more than once, for lines of kinds `which`; the outer transform encodes a line once."""

    def hashes(wide: bool) -> Column:
        return F.transform(F.array(_encoded(line, wide)), lambda e: F.transform(F.sequence(F.lit(1), _last(e, wide), F.lit(_unit(wide))), lambda i: _hash(e, i, wide)))

    return F.get(F.when(_wide(line), hashes(True)).otherwise(hashes(False)) if len(which) > 1 else hashes(*which), F.lit(0))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of lines with a word."""
    d = columns(docs, doc_id="doc_id", text="text")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.octet_length(F.ltrim("line", F.lit(" \t\n\v\f\r"))) > 0)


def narrow(docs: DataFrame) -> bool:
    """Whether all places are longs, which take a fraction of the time of decimals."""
    ends = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("i")).agg(F.min("i"), F.max("i")).first()
    return all(i is None or abs(i) < -NARROW_NO_ID for i in ends)


def place_of(doc_id: Column, line_no: Column, short: bool = False) -> Column:
    """A number in the order of doc_id, null first, and line_no: unlike a struct its minimum needs no sort. short: a long, for `narrow` tables."""
    if short:
        return F.shiftleft(F.coalesce(doc_id.cast("long"), F.lit(NARROW_NO_ID)), 31).bitwiseOR(line_no.cast("long"))
    return (F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(NO_ID)).cast("decimal(20,0)")) * F.lit(LINES) + line_no).cast("decimal(38,0)")


def head_of(place: str, short: bool = False) -> Column:
    """The (doc_id, line_no) of a place: by the bits of a long where it is one, else by division."""
    if short:
        number = F.shiftright(place, 31)
        return F.struct(F.when(number > NARROW_NO_ID, number).alias("doc_id"), F.col(place).bitwiseAND(F.lit(LINES - 1)).cast("int").alias("line_no"))
    bits = F.col(place).try_cast("long")
    line_no = F.pmod(place, F.lit(LINES))
    number = ((F.col(place) - line_no) / F.lit(LINES)).cast("decimal(20,0)")
    long_ = F.when(number > F.lit(str(NO_ID)).cast("decimal(20,0)"), number).cast("long")
    return F.struct(F.coalesce(F.shiftright(bits, 31), long_).alias("doc_id"), F.coalesce(bits.bitwiseAND(F.lit(LINES - 1)).cast("int"), line_no.cast("int")).alias("line_no"))


def chunks(lines: DataFrame, size: int, wide: bool, *keep: str) -> DataFrame:
    """A row for every `size` shingles of a line that is `wide` or not, with their hashes h0, h1, ...; past the line's end the last shingle stands again.

    `lines` may have a column `wide`. What is made for each of many numbers is
    SQL text here and below: a Column takes several calls from Python for each
    of its nodes, and thousands of nodes are what fills the driver.
    """
    unit, kind = _unit(wide), F.col("wide") if "wide" in lines.columns else _wide(F.col("line"))
    e = lines.where(kind if wide else ~kind).select(*keep, _encoded(F.col("line"), wide).alias("e")).withColumn("last", _last(F.col("e"), wide))
    rows = e.select("*", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(unit * size))).alias("at"))
    place = lambda k: f"least(last, at | {unit * k})"  # noqa: E731  or: places are 1 plus a multiple of the chunk
    cut = lambda k: f"substring(e, {place(k)}, {unit * WIDTH})"
    hashed = lambda k: f"xxhash64(encode(decode({cut(k)}, 'UTF-32'), 'UTF-16BE'))" if wide else f"xxhash64({cut(k)})"
    return rows.selectExpr(*keep, *(f"{hashed(k)} AS h{k}" for k in range(size)))


def _rotated(h: str, turn: int) -> str:
    return f"shiftleft({h}, {64 // TURNS * turn}) | shiftrightunsigned({h}, {64 - 64 // TURNS * turn})" if turn else h


def kinds(lines: DataFrame) -> tuple[bool, ...]:
    """The values of `wide` that need a plan of their own: mostly no line is wide, and half of it is saved."""
    return (False,) if lines.where("wide").isEmpty() else (False, True)


def _of_kinds(made: Callable[[bool], DataFrame], which: tuple[bool, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, map(made, which))


def signed(distinct: DataFrame, which: tuple[bool, ...] = (False, True)) -> DataFrame:
    """(id, bands) of the lines of `distinct`, of kinds `which`; most of the minimum is taken within a row, the rest before anything is moved."""
    nearest = lambda c: F.expr(f"min(least({', '.join(f'h{k}_{c % TURNS} ^ ({NEAR[c]}L)' for k in range(CHUNK))})) AS m{c}")

    def mins(wide: bool) -> DataFrame:
        turned = chunks(distinct, CHUNK, wide, "id").selectExpr("id", *(f"{_rotated(f'h{k}', t)} AS h{k}_{t}" for k in range(CHUNK) for t in range(TURNS)))
        return turned.groupBy("id").agg(*(nearest(c) for c in range(COORDINATES)))

    bands = (f"xxhash64({b}, {', '.join(f'm{c}' for c in cs)}) & ({~PLACE}L) | {b}L" for b, cs in enumerate(BANDS))
    return _of_kinds(mins, which).selectExpr("id", f"array({', '.join(bands)}) AS bands")


def _place(band: Column) -> Column:
    return band.bitwiseAND(F.lit(PLACE))


def mapped(lines: DataFrame, which: tuple[bool, ...] = (False, True)) -> DataFrame:
    """(id, room, x0, x1, ...): the size of the set of each of `lines` (id, line), of kinds `which`, and the words of its bitmap."""
    sets = lines.select("id", F.array_distinct(shingles(F.col("line"), which)).alias("set")).selectExpr("id", "set", "size(set) AS n")
    rows = sets.selectExpr("id", "n", "set", f"explode(sequence(0, n - 1, {MAP_CHUNK})) AS at")
    of = rows.selectExpr("id", "n", *(f"get(set, at + {k}) AS h{k}" for k in range(MAP_CHUNK)))
    # Past the set's end a word that isn't there, and no bit.
    bit = lambda k: f"coalesce(shiftleft(1L, int(shiftrightunsigned(h{k}, 32) & 63)), 0L) AS b{k}"
    split = of.selectExpr("id", "double(n) AS room", *(c for k in range(MAP_CHUNK) for c in (f"coalesce(h{k} & {WORDS - 1}L, {WORDS}L) AS w{k}", bit(k))))
    word = lambda w: F.expr(f"bit_xor({' ^ '.join(f'if(w{k} = {w}L, b{k}, 0L)' for k in range(MAP_CHUNK))}) AS x{w}")
    return split.groupBy("id", "room").agg(*(word(w) for w in range(WORDS)))


def may_be(similarity: float) -> str:
    """Whether sizes and bitmaps of two lines, a and b, leave room for the similarity. Sums of doubles, as those of integers are checked at some cost."""
    differ = " + ".join(f"double(bit_count(x{w}_a ^ x{w}_b))" for w in range(WORDS))
    return " AND ".join(f"({d}) * {1 + similarity!r}D <= (room_a + room_b) * {1 - similarity!r}D + 1e-6D" for d in ("abs(room_a - room_b)", differ))


def _among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `df` whose id is one of the distinct `ids`."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _sides(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """`df` twice, its id called a and b and its other columns by names that end so."""
    return tuple(df.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in names)) for x in "ab")


def similar(pairs: DataFrame, lines: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    a, b = _sides(maps, *MAP)
    met = written(pairs.join(a, "a").join(b, "b").where(may_be(similarity)).select("a", "b", (F.col("room_a") + F.col("room_b")).alias("room")))
    a, b = _sides(lines, "line")
    found = written(alike(met.join(a, "a").join(b, "b"), similarity).select("a", "b"))
    dropped(met)
    return found


def alike(both: DataFrame, similarity: float) -> DataFrame:
    """The rows (line_a, line_b, room) whose whole sets are similar enough; room: the sizes of both sets together.

    What they share is made once for a row: a filter on it alone would take the
    place of the projection and make it again wherever it names it, and `row`
    keeps it from that.
    """
    shared = F.size(F.array_intersect(shingles(F.col("line_a")), shingles(F.col("line_b"))))
    close = shared >= F.lit(similarity) * (F.col("room") - shared)
    return both.select("*", close.alias("close"), F.monotonically_increasing_id().alias("row")).where("close and row >= 0")


def across(rows: DataFrame, lines: DataFrame, maps: DataFrame, comps: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs of different components in the lists (band, id) that reach several.

    The join on the list verifies the pairs itself, each in the first list that
    both are in: by sizes and bitmaps, then on sets of 32-bit hashes with room
    for one collision. So it gives out hardly any that aren't similar.
    """
    placed = written(rows.join(comps.toDF("id", "comp"), "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp")))
    open_ = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band")
    left = written(placed.join(open_, "band"))
    ids = written(left.select("id").distinct())
    short = F.array_distinct(F.transform(shingles(F.col("line")), lambda h: F.hash(h)))
    earlier = [f"band{k}" for k in range(len(BANDS) - 1)]
    sets = written(_among(lines, ids).select("id", *(F.get("bands", F.lit(k)).alias(c) for k, c in enumerate(earlier)), short.alias("set")).join(maps, "id").withColumn("n", F.size("set").cast("double")))
    # Less than 100 columns, and no nulls among them, keep the join in compiled code.
    numbers = ["comp", "n", *MAP, *earlier]
    sized = left.join(sets, "id").selectExpr("band", *(f"coalesce({c}, 0) AS {c}" for c in ("id", *numbers)), "set")
    mine, other = (sized.selectExpr(f"band AS {band}", f"id AS {x}", *(f"{c} AS {c}_{x}" for c in (*numbers, "set"))) for x, band in (("a", "band"), ("b", "list")))
    met = ["band = list", "a < b", "comp_a <> comp_b", may_be(similarity)]
    met += [f"((band & {PLACE}L) <= {k} OR {c}_a <> {c}_b)" for k, c in enumerate(earlier)]
    met = F.expr(" AND ".join([*met, f"(double(size(array_intersect(set_a, set_b))) + 1) * {1 + similarity!r}D >= (n_a + n_b) * {similarity!r}D"]))
    found = similar(mine.join(other, met).select("a", "b"), lines, maps, similarity)
    dropped(placed, left, ids, sets)
    return found


def linked_components(distinct: DataFrame, similarity: float) -> DataFrame:
    """(id, component) of the lines that are linked with others; distinct: (id, line, wide), which is dropped as soon as it has been read."""
    which = kinds(distinct)
    signs = written(signed(distinct.select("id", "line", "wide"), which))
    posts = signs.select("id", F.explode("bands").alias("band"))
    # Two hubs of a list, others for each HUB_BANDS bands: lists of the same lines share theirs.
    turn = F.expr("CASE " + " ".join(f"WHEN (band & {PLACE}L) < {b + HUB_BANDS} THEN ({NEAR[b]}L)" for b in range(0, len(BANDS), HUB_BANDS)) + " END")
    far = F.col("id").bitwiseXOR(turn)
    sizes = posts.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(far).alias("low"), F.max(far).alias("high"))
    lists = written(sizes.where("n > 1").select("band", "n", *(F.col(c).bitwiseXOR(turn).alias(c) for c in ("low", "high"))))
    long_ = lists.where("n > 2")
    rows = written(posts.join(F.broadcast(long_) if long_.count() <= BROADCAST_LISTS else long_, "band"))
    # Lists of up to three lines are compared in full by their two hubs.
    hubs = F.array(F.struct(F.col("low").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("high").alias("b")))
    pairs = lists.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(rows.select(F.inline(hubs))).where("a <> b")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    lines = written(_among(distinct.select("id", "line", "wide"), ids).join(_among(signs, ids), "id"))
    maps = written(mapped(lines, which))
    dropped(signs, distinct, lists, ids)
    edges = similar(pairs, lines, maps, similarity)
    comps = written(components(edges))
    dropped(pairs, edges)
    more = across(rows.where("n > 3").select("band", "id"), lines, maps, comps, similarity)
    found = written(components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)))
    dropped(rows, lines, maps, comps, more)
    return found


def dedup_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, line_no, line_id, first_doc_id, first_line_no, kept for each line with a word.

    first_*: the line that stays for this one's component.
    """
    lines = lines_of(docs).withColumn("id", line_id(F.col("line")))
    short = narrow(docs)
    place = place_of(F.col("doc_id"), F.col("line_no"), short)
    distinct = written(lines.groupBy("id", "line").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).withColumn("wide", _wide(F.col("line"))), "snappy")
    places = written(distinct.select("id", "place", "n"))
    comps = linked_components(distinct, similarity)
    # Only lines that stand in several places or are linked have a head elsewhere; the others are their own.
    some = written(places.join(F.broadcast(comps) if comps.count() <= BROADCAST_IDS else comps, "id", "left").where("n > 1 or component is not null").select("id", "place", F.coalesce("component", "id").alias("component")))
    heads = some.groupBy("component").agg(F.min("place").alias("head"))
    whose = written(some.join(heads, "component").select("id", head_of("head", short).alias("head")))
    dropped(places, comps, some)
    own = F.col("head").isNull()
    kept = own | F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("line_no") == F.col("head.line_no"))
    return (
        lines.select("doc_id", "line_no", "id").join(whose, "id", "left")
        .select("doc_id", "line_no", F.col("id").alias("line_id"), F.when(own, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("first_doc_id"), F.when(own, F.col("line_no")).otherwise(F.col("head.line_no")).alias("first_line_no"), kept.alias("kept"))
    )


def drop_repeated_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """`docs` with the texts' repeated lines taken out, with its own columns.

    A document that loses all its words goes too: what it said stands in the documents its lines were found in before.
    """
    found = dedup_lines(docs, similarity).where("not kept")
    gone = found.groupBy(F.struct("doc_id").alias("k")).agg(F.collect_set(F.xxhash64("line_no", "line_id")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id").alias("k")).join(gone, "k", "left")
    left = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", F.xxhash64(i, line_id(x))))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    changed = rows.select("row", "gone", text.alias("left"))
    whole = changed.where(F.col("gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return whole.select(F.col("row").withField("text", F.col("left")).alias("row")).select("row.*")
