"""Near-duplicate operators against brute force."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import embedding_dedup, line_dedup, minhash_dedup
from tidewatch.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, token string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows], DOC)


def united(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_sets(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 120)))) for i in range(120)]
    base = [word() for _ in range(150)]
    for i in range(120):  # a chain of near copies, at all similarities
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(150)] = word()
        mine = list(base)
        for _ in range(rng.randint(0, 8)):
            mine[rng.randrange(150)] = word()
        rows.append((200 + i, " ".join(mine)))
    rows += [(400 + i, rows[5][1].upper() + "  \n") for i in range(40)]
    passage = " ".join(word() for _ in range(60))
    rows += [(500 + i, passage + " " + " ".join(word() for _ in range(rng.randint(2, 60)))) for i in range(90)]
    rows += [(700, None), (701, ""), (702, " \n"), (703, "one"), (704, "ONE"), (705, "one two"), (706, "ünï cödé wörds"), (None, "one two"), (707, "w " * 30000), (708, "w " * 29000)]
    rng.shuffle(rows)
    return rows


def test_minhash_join(spark):
    for width, percent in ((3, 85), (5, 80)):
        rows = corpus(width)
        sets = {i: brute_sets(t, width) for i, t in rows if i is not None}
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = united(sets, links)
        got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, rows), width, percent).collect()}
        assert len(got) == len(rows)
        assert {i: got[i].n_shingles for i in sets} == {i: len(s) for i, s in sets.items()}
        assert {i: got[i].component_id for i in sets} == want
        assert all(got[i].kept == (want[i] == i) for i in sets)
        assert got[None].component_id == 705 and not got[None].kept


def test_minhash_long_lists(spark, monkeypatch):
    """Lists of every length go the way of long ones."""
    monkeypatch.setattr(minhash_dedup, "SHORT_LIST", 1)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "HEAVY", 8)
    rows = corpus(9)
    sets = {i: brute_sets(t, 3) for i, t in rows if i is not None}
    want = united(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert {i: got[i] for i in sets} == want


def test_minhash_empty_and_dropping(spark):
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "x y z"), (3, "q r s t"), (4, None), (None, "x y z")]
    left = minhash_dedup.drop_near_duplicates(docs(spark, rows))
    assert left.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 3, 4]


def test_minhash_repeated_and_null_ids(spark):
    """Rows are judged by their own texts, whatever their ids."""
    a, b, c = ("".join(f"{x}{k} " for k in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, "x y z"), (3, "q r s t"), (None, c), (None, c + "end"), (None, c.upper()), (None, "x y z"), (None, "alone"), (5, c + " far"), (4, None), (None, ""), (6, "n m"), (6, "n m")]
    some = [r for r in rows if r[0] != 5]
    for given_, cs in ((rows, [(5, c + " far")]), (some, [(None, c)])):
        left = sorted(((r.doc_id, r.text) for r in minhash_dedup.drop_near_duplicates(docs(spark, given_), one_per_id=False).collect()), key=str)
        want = [(1, a), (2, b), (3, "x y z"), (3, "q r s t"), (None, "alone"), (4, None), (None, ""), (6, "n m"), *cs]
        assert [(i, t if i or not t or t[0] not in "cC" else c) for i, t in left] == sorted(want, key=str)
    near = [(1, b + "end"), (2, a), (2, b)]
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(docs(spark, near)).select("doc_id", "component_id", "kept").collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = united({x for p in links for x in p}, links)
    assert got == {i: want[i] for i in got} and {x for a, b in links if a != b for x in (a, b)} == set(got)


def char_sets(line):
    return {line[k : k + 10] for k in range(max(1, len(line) - 9))}


def test_lines(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = [[word() for _ in range(30)] for _ in range(25)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base)) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 40))]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 9])):
                line[rng.randrange(len(line))] = word()
            lines.append(" ".join(line))
        rows.append((i, "\n".join([*lines, "", "  "])))
    rows += [(900, None), (901, ""), (902, "漢字" * 60 + "\n" + "漢字" * 60 + "終"), (903, "x" * 20000), (904, "x" * 20000 + "\n" + "x" * 19990), (None, "hello there")]
    data = docs(spark, rows)
    got = {(r.doc_id, r.line_no): r for r in line_dedup.dedup_lines(data).collect()}
    places = {(i, k): x for i, t in rows if t for k, x in enumerate(t.split("\n")) if x.split()}
    assert set(got) == set(places)
    sets = {x: char_sets(x) for x in places.values()}
    order = {p: n for n, p in enumerate(sorted(places, key=lambda p: (p[0] is not None, p)))}
    ids = {n: places[p] for p, n in order.items()}
    links = [(a, b) for a in ids for b in ids if a < b and len(sets[ids[a]] & sets[ids[b]]) >= 0.8 * len(sets[ids[a]] | sets[ids[b]])]
    want = united(ids, links)
    same = [order[got[p].first_doc_id, got[p].first_line_no] == want[n] for p, n in order.items()]
    assert np.mean(same) > 0.98
    # Nothing is united that isn't linked, directly or through others.
    assert all(want[order[got[p].first_doc_id, got[p].first_line_no]] == want[n] for p, n in order.items())
    assert all(r.kept == ((r.first_doc_id, r.first_line_no) == p) for p, r in got.items())
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(data).collect()}
    for i, t in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in got or got[i, k].kept]
        changed = len(kept) < len((t or "").split("\n"))
        if changed and not " ".join(kept).split():
            assert i not in left
        else:
            assert left[i] == ("\n".join(kept) if changed else t)


def test_lines_of_shifted_text(spark):
    """Near copies that start elsewhere are found, spaced or not; the truth is made in plain Python."""
    rng = random.Random(6)
    kinds = ["abcdefghijklmnopqrstuvwxyz0123456789+/", "漢字仮名交文日本語中国東京大阪", "😀😁😂🤣😃😄é漢", "abcdefgh  "]
    lines = []
    for _ in range(12):
        for letters in kinds:
            base = "".join(rng.choice(letters) for _ in range(rng.choice([60, 300, 900])))
            inside = rng.randrange(10, 50)
            lines += [base, rng.choice(letters) + base, letters[:3] + base, base[:inside] + letters[1] + base[inside:], base[1:], base[len(base) // 2 :]]
    lines += ["short", "short", "shorts", "0123456789", "0123456789a", "x" * 9, "x" * 10, "x" * 30000]
    whole = {k: {x[i : i + 10] for i in range(max(1, len(x) - 9))} for k, x in enumerate(lines)}
    made = spark.createDataFrame(list(enumerate(lines)), "k int, line string").select("k", line_dedup.F.array_distinct(line_dedup.shingles(line_dedup.F.col("line"))).alias("s"))
    assert {r.k: len(r.s) for r in made.collect()} == {k: len(s) for k, s in whole.items()}
    links = [(a, b) for a in whole for b in whole if a < b and len(whole[a] & whole[b]) >= 0.8 * len(whole[a] | whole[b])]
    want = united(whole, links)
    got = {r.doc_id: r.first_doc_id for r in line_dedup.dedup_lines(docs(spark, list(enumerate(lines)))).collect()}
    assert all(want[got[k]] == want[k] for k in whole)
    assert np.mean([got[k] == want[k] for k in whole]) > 0.98
    assert len(links) > 400


def test_lines_recall(spark):
    """Pairs of similarity 0.8 to 0.9, each alone, against shingles made in plain Python."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    lines, wanted, unlike = [], [], []
    while len(wanted) < 300:
        line = [word() for _ in range(rng.randint(8, 90))]
        other = list(line)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(len(other))] = word()
        a, b = " ".join(line), " ".join(other)
        j = len(char_sets(a) & char_sets(b)) / len(char_sets(a) | char_sets(b))
        if 0.7 <= j <= 0.9:
            (wanted if j >= 0.8 else unlike).append((len(lines), len(lines) + 1))
            lines += [a, b]
    got = {r.doc_id: r.first_doc_id for r in line_dedup.dedup_lines(docs(spark, list(enumerate(lines)))).collect()}
    assert np.mean([got[a] == got[b] for a, b in wanted]) >= 0.95
    assert not any(got[a] == got[b] for a, b in unlike) and len(unlike) > 50


def test_line_sketches_hold_the_lines_shingles(spark):
    """What is signed and mapped are a line's shingles and no others, at every length and in every kind of line; kinds agree on shingles they share."""
    F = line_dedup.F
    rng = random.Random(8)
    lines = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdef ", "漢字é仮名b", "😀😁bé漢") for n in (*range(1, 60), 700)]
    lines += [x for k in (0, 30, 58) for x in (lines[k] + "0123456789abc", lines[120 + k] + "😀0123456789abc")]
    made = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    cut = {x[i : i + 10] for x in lines for i in range(max(1, len(x) - 9))}
    names = {r.h: r.s for r in spark.createDataFrame([(s,) for s in cut], "s string").select("s", F.xxhash64(F.encode("s", "UTF-16BE")).alias("h")).collect()}
    for size in (1, line_dedup.MAP_CHUNK, line_dedup.CHUNK):
        got = {k: set() for k in range(len(lines))}
        for wide in (False, True):
            for r in line_dedup.chunks(made, size, wide, "id").collect():
                got[r.id] |= {names.get(h) for h in r[1:]}
        assert got == {k: char_sets(x) for k, x in enumerate(lines)}
    for r in made.select("id", line_dedup.shingles(F.col("line")).alias("s")).collect():
        assert {names[h] for h in r.s} == char_sets(lines[r.id])


def test_line_bands():
    """Few bands, so few rows for each line, in which a pair at 0.8 meets nearly always."""
    bands, n = line_dedup.BANDS, line_dedup.COORDINATES
    meets = lambda s: sum(s ** m.bit_count() * (1 - s) ** (n - m.bit_count()) for m in range(1 << n) if any(all(m >> c & 1 for c in b) for b in bands))
    assert len(bands) <= 6 and meets(0.8) > 0.98 and meets(0.85) > 0.996
    assert {c for b in bands for c in b} == set(range(n)) and len(bands) <= line_dedup.PLACE + 1


def test_line_plans_are_small(spark, monkeypatch):
    """Signing and mapping lines builds few Columns, and a second plan for wide lines only where there are some."""
    F = line_dedup.F
    made = spark.createDataFrame([(1, "one line of text é漢", False), (2, "another", False)], "id long, line string, wide boolean")
    both = made.union(spark.createDataFrame([(3, "wide 😀", True)], "id long, line string, wide boolean"))
    assert line_dedup.kinds(made) == (False,) and line_dedup.kinds(both) == (False, True)
    assert both.select("wide", line_dedup._wide(F.col("line")).alias("found")).where("wide <> found").isEmpty()
    assert made.select(line_dedup._wide(F.lit("a\U0010ffff\uffff")).alias("x"), line_dedup._wide(F.lit("\uffff\ufeff\u0fff\u00f0\u00f4")).alias("y")).where("not x or y").isEmpty()
    calls = []
    for name in ("bitwiseXOR", "bitwiseOR", "bitwiseAND", "alias"):
        whole = getattr(type(F.lit(1)), name)
        monkeypatch.setattr(type(F.lit(1)), name, lambda *a, f=whole, n=name: calls.append(n) or f(*a))
    for found in (line_dedup.signed(made, (False,)), line_dedup.mapped(made, (False,))):
        assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() == 2
    assert len(calls) < 60


def test_line_maps_rule_out_long_unlike_lines(spark):
    """Bitmaps tell sets apart however long they are, and rule out no pair that is similar, repeated shingles or not."""
    F = line_dedup.F
    rng = random.Random(17)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    lines = []
    for n in (200, 1000, 4000, 20000):
        for share in (0.97, 0.92, 0.88, 0.86, 0.7, 0.5):
            base = text(n)
            lines += [base, base[: round(n * share)] + text(n - round(n * share))]
    lines += ["x" * 9, "x" * 10, "x" * 30000, "x" * 29990, "ab" * 500, "ab" * 300, "é漢" * 40, "é漢" * 39, "no", "nö", "😀" * 30 + lines[0], lines[0]]
    whole = [char_sets(x) for x in lines]
    made = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "id long, line string")
    for which in ((False, True), (False,)):
        narrow = [k for k, x in enumerate(lines) if len(which) > 1 or "😀" not in x]
        maps = line_dedup.mapped(made.where(F.col("id").isin(narrow)), which)
        assert {r.id: r.room for r in maps.collect()} == {k: len(whole[k]) for k in narrow}
        a, b = line_dedup._sides(maps, *line_dedup.MAP)
        met = {(r.a, r.b) for r in a.join(b, F.expr("a < b")).where(line_dedup.may_be(0.8)).select("a", "b").collect()}
        alike = {(a, b): len(whole[a] & whole[b]) / len(whole[a] | whole[b]) for a in narrow for b in narrow if a < b}
        assert all(p in met for p, j in alike.items() if j >= 0.8)
        assert not [p for p in met if min(len(whole[k]) for k in p) <= 1000 and alike[p] < 0.6]


def test_narrow_places_of_lines(spark):
    """Places of small document numbers are longs, in the order of the others; larger numbers anywhere keep decimals."""
    F = line_dedup.F
    ids = [None, -(1 << 32) + 1, -(1 << 31) - 1, -1, 0, 1, 1 << 31, (1 << 32) - 1]
    want = [(i, k) for i in ids for k in (0, 1, (1 << 31) - 1)]
    made = spark.createDataFrame(want, "d long, k int").select(line_dedup.place_of(F.col("d"), F.col("k"), True).alias("p"))
    assert made.schema["p"].dataType.simpleString() == "bigint"
    assert [tuple(r.h) for r in made.orderBy("p").select(line_dedup.head_of("p", True).alias("h")).collect()] == want
    lines = [(i, "the same line of text again\nanother line of text here") for i in ids]
    for more, narrow in (([], True), ([1 << 32], False), ([-(1 << 32)], False), ([-(1 << 63)], False)):
        data = docs(spark, [*lines, *((i, lines[0][1]) for i in more)])
        assert line_dedup.narrow(data) == narrow
        got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in line_dedup.dedup_lines(data).collect()}
        assert got == {(i, k): (None, k, i is None) for i in [*ids, *more] for k in (0, 1)}
    assert line_dedup.narrow(docs(spark, [])) and line_dedup.narrow(docs(spark, [(None, "x")]))


def test_places_of_lines(spark):
    """Places tell document and line, in order, for numbers of every size and none."""
    F = line_dedup.F
    ids = [None, -(1 << 63), -(1 << 40), -(1 << 32) - 1, -(1 << 32), -1, 0, 1, (1 << 32) - 1, 1 << 32, 1 << 40, (1 << 63) - 1]
    want = [(i, k) for i in ids for k in (0, 1, (1 << 31) - 1)]
    made = spark.createDataFrame(want, "d long, k int").select(line_dedup.place_of(F.col("d"), F.col("k")).alias("p"))
    assert [tuple(r.h) for r in made.orderBy("p").select(line_dedup.head_of("p").alias("h")).collect()] == want


def test_lines_in_one_list(spark):
    """Many lines that share bands but hang together by few links."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    base, lines = [word() for _ in range(40)], []
    for _ in range(150):
        line = list(base)
        for k in rng.sample(range(40), rng.randint(1, 4)):
            line[k] = word()
        lines.append(" ".join(line))
    sets = [char_sets(x) for x in lines]
    links = [(a, b) for a in range(150) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = united(range(150), links)
    got = {r.doc_id: r.first_doc_id for r in line_dedup.dedup_lines(docs(spark, list(enumerate(lines)))).collect()}
    assert 10 < len(set(want.values())) < 145 and np.mean([got[k] == want[k] for k in want]) > 0.97


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, note string")


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1, 2):
        centres = rng.normal(size=(25, 16))
        for c in centres:
            for _ in range(int(rng.integers(1, 60))):
                rows.append((k, (c + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.4])).astype(np.float32).tolist(), label, ""))
                k += 1
    rows += [(k + i, rows[3][1], rows[3][2], "copy") for i in range(200)]
    k += 200
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3, [1e-30] * 16]
    rows += [(k + i, v, 1, "odd") for i, v in enumerate(odd)] + [(k + 20, rows[0][1], None, "no label"), (None, rows[0][1], 0, "no id")]
    x, owner = {}, {}
    for i, v, label, _ in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            a = np.array(v, np.float64)
            x.setdefault((label, len(v)), []).append(a / np.linalg.norm(a))
            owner.setdefault((label, len(v)), []).append(i)
    links, count = [], Counter()
    for g, vs in x.items():
        m = np.array(vs) @ np.array(vs).T >= 0.93
        for a, b in zip(*np.nonzero(np.triu(m, 1)), strict=True):
            links.append((owner[g][a], owner[g][b]))
            count[owner[g][a]] += 1
            count[owner[g][b]] += 1
    want = united([r[0] for r in rows if r[0] is not None], links)
    for capacity in (None, 150):  # one shard for each label, and several
        got = {r.vec_id: r for r in embedding_dedup.near_vectors(vectors(spark, rows), 0.93, capacity).collect()}
        assert len(got) == len(rows)
        assert sum(got[i].n_links == count[i] for i in want) >= 0.99 * len(want)
        assert sum(r.n_links for r in got.values()) >= 0.98 * sum(count.values())
        assert sum(got[i].component_id == want[i] for i in want) >= 0.99 * len(want)
        assert all(got[i].kept == (got[i].component_id == i) for i in want) and got[None].kept and not got[None].n_links
    assert embedding_dedup.near_vectors(vectors(spark, [])).count() == 0


def test_embeddings_repeated_ids_and_extra_columns(spark):
    """A vec_id with two vectors: each row is counted by its own; columns of the same names as inner ones don't clash."""
    x, y, z = [1.0, 0.0, 0.02], [1.0, 0.0, 0.1], [1.0, 0.0, -0.1]
    rows = [(1, x, 0, "n"), (2, y, 0, "n"), (2, z, 0, "n"), (3, [0.0, 1.0, 0.0], 0, "n"), (3, [0.0, 1.0, 0.0], 0, "n")]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string").selectExpr("*", "1 as rep", "2 as dim", "3 as shard")
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(data, 0.9).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 3, True), (3, 1, 3, True)]
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(data, 0.99).collect())
    assert [(v, n) for v, n, *_ in got] == [(1, 2), (2, 1), (2, 1), (3, 1), (3, 1)]


def test_graph_recall():
    rng = np.random.default_rng(8)
    x = embedding_dedup.unit(rng.normal(size=(3000, 24))).astype(np.float32)
    graph = embedding_dedup.Graph.build(x)
    q = x[:200]
    ids, _ = embedding_dedup.beam_search(x, graph.layers[0], q, graph._entry(q, 0), 64)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(true.tolist(), ids.tolist(), strict=True)]) > 0.9
    assert len(graph.layers) > 2


def test_audit_falls_back_to_every_node():
    rng = np.random.default_rng(2)
    x = embedding_dedup.unit(rng.normal(size=(300, 8))).astype(np.float32)
    broken = embedding_dedup.Graph(x, [np.full((300, 32), -1, np.int64)], 0)
    a, b = broken.audited_hits(x, 0.8)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(z.tolist() for z in np.nonzero(x @ x.T >= 0.8)), strict=True))
