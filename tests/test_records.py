"""Record files, themes, URLs, places and the silver table."""

import json
import zipfile
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import locations, text, urls
from tidewatch.operators import features, reports, silver
from tidewatch.schemas import GKG_FIELDS, SILVER_COLUMNS
from tidewatch.sources import gkg

HEAD = ["GKGRECORDID", "V2.1DATE", "V2SOURCECOMMONNAME", "V2DOCUMENTIDENTIFIER", "V2ENHANCEDTHEMES", "V2ENHANCEDLOCATIONS", "V1.5TONE"]
ROWS = [
    ["sample-001", "20260819120000", "example.com", "https://Example.com/news/veracruz-flood/?utm_source=newsletter#top", "NATURAL_DISASTER_FLOOD,10", "4#Veracruz#MX#MX30##19.2#-96.1#1#10", "-4.5,1,2"],
    ["sample-002", "20260819121500", "example.com", "https://example.com/news/veracruz-flood?fbclid=x", "NATURAL_DISASTER_FLOOD,10", "4#Veracruz#MX#MX30##19.2#-96.1#1#10", "-4"],
    ["sample-003", "20260819121500", "fire.test", "https://fire.test/a", "NATURAL_DISASTER_WILDFIRE,1", "", ""],
    ["sample-004", "20260819124500", "local.test", "https://local.test/x?section=local&utm_medium=rss", "ENV_FLOOD,3;TAX,9", "1#United States#US#US##39#-98#US#10;3#Baton Rouge#US#USLA#LA033#30.4#-91.1#2#40", "1.5"],
    ["sample-005", "20260819130000", "odd.test", "https://odd.test/y", "FLOOD", "2#Unknown#US#USXX##125#-190#-1#20", "bad"],
]


@pytest.fixture()
def sample(tmp_path):
    path = tmp_path / "sample.tsv"
    path.write_text("\n".join("\t".join(r) for r in [HEAD, *ROWS, ["", ""]]) + "\n", encoding="utf-8")
    return str(path)


def test_sample_end_to_end(spark, sample):
    records = gkg.read_gkg(spark, [sample])
    out = silver.silver(records, "flood", "high")
    assert out.columns == SILVER_COLUMNS
    n = silver.counters(records, out, 1)
    assert (n["input_rows"], n["theme_matched_rows"], n["weak_rows_skipped"], n["disaster_rows"], n["duplicate_rows"], n["output_rows"]) == (5, 4, 0, 4, 1, 3)
    rows = silver.in_order(out).collect()
    assert [r.canonical_url for r in rows] == ["https://example.com/news/veracruz-flood", "https://local.test/x?section=local", "https://odd.test/y"]
    assert [r.record_id for r in rows] == ["sample-001", "sample-004", "sample-005"]
    assert rows[1].adm2_code == "LA033" and rows[1].quality_flags == ["multiple_locations", "ambiguous_region"] and rows[2].quality_flags == ["invalid_coordinates"]
    assert rows[0].seen_at == datetime(2026, 8, 19, 12) and rows[0].tone == -4.5 and rows[2].tone is None
    report = reports.quality_report(out)
    assert (report["row_count"], report["unique_domain_count"], report["invalid_coordinate_count"], report["multiple_location_count"]) == (3, 3, 1, 1)
    counts = features.hourly_counts(out).collect()
    assert len(counts) == 3 and counts[0].window_start == datetime(2026, 8, 19, 12)


def test_a_file_given_twice(spark, sample):
    records = gkg.read_gkg(spark, [sample, sample])
    n = silver.counters(records, silver.silver(records, "flood", "weak"), 2, "flood", "weak")
    assert (n["input_files"], n["input_rows"], n["disaster_rows"], n["duplicate_rows"], n["output_rows"]) == (2, 10, 8, 5, 3)


def test_zip_without_header(spark, tmp_path):
    row = dict.fromkeys(GKG_FIELDS, "") | {"GKGRECORDID": "zip-001", "V2.1DATE": "20260820120000", "V2DOCUMENTIDENTIFIER": "https://z.test/1", "V2ENHANCEDTHEMES": "NATURAL_DISASTER_FLOOD,1"}
    with zipfile.ZipFile(tmp_path / "a.gkg.csv.zip", "w") as z:
        z.writestr("sample.gkg.csv", "\t".join(row.values()) + "\n")
    out = silver.silver(gkg.read_gkg(spark, str(tmp_path), "*.zip")).collect()
    assert [(r.record_id, r.location_selection_status, r.geo_confidence, r.quality_flags) for r in out] == [("zip-001", "missing", "missing", ["missing_location"])]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("read.me", "")
    with pytest.raises(ValueError):
        list(gkg.read_records(str(tmp_path / "b.zip")))
    with pytest.raises(FileNotFoundError):
        gkg.find_inputs(str(tmp_path), "*.none")


def test_quoting_and_columns(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('first\t2\t"a ""quoted""\nline"\n\n\t\nlast\n', encoding="utf-8")
    rows = list(gkg.read_records(str(tmp_path / "q.tsv")))
    assert [len(r) for r in rows] == [3, 1] and rows[0]["V2SOURCECOLLECTIONIDENTIFIER"] == 'a "quoted"\nline'
    got = spark.read.format("gkg").option("path", str(tmp_path / "q.tsv")).option("columns", json.dumps(["GKGRECORDID"])).load()
    assert [tuple(r) for r in got.collect()] == [("first", "q.tsv", 0, 0), ("last", "q.tsv", 0, 1)]


def test_guards(spark, sample):
    records = gkg.read_gkg(spark, [sample])
    for bad in (lambda: silver.silver(records, "quake"), lambda: silver.silver(records, "flood", "some"), lambda: gkg.read_gkg(spark, [])):
        with pytest.raises(ValueError):
            bad()


def test_the_theme_filter_runs_before_the_url_function(spark, sample):
    plan = silver.silver(gkg.read_gkg(spark, [sample]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Filter") and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize(("theme", "hazard", "want"), [
    ("NATURAL_DISASTER_FLOODING", "flood", "high"), ("NATURAL_DISASTER_FLOODED", "flood", "weak"), ("WB_154_FLOOD_PROTECTION", "flood", "weak"), ("WB_1_FLOOD", "flood", "weak"),
    ("FLOOD", "flood", "high"), ("WILDFIRE", "wildfire", "weak"), ("NATURAL_DISASTER_WILDFIRE", "wildfire", "high"), ("TAX", "flood", None)])
def test_strength(spark, theme, hazard, want):
    row = spark.range(1).select(F.array(F.lit(theme)).alias("t")).select(text.match_strength(text.matched_themes("t", hazard), hazard).alias("s"))
    assert row.first().s == want


def test_tokens_and_numbers(spark):
    df = spark.createDataFrame([(" flood ,1;TAX,2;;flood,9", "a;Tax", "20260819120000", "-4.5e1", "3"), (None, "", "202608191200", "1d", "3.0"), (" x\t", None, "20261319120000", "1_0", " 7 ")], "a string, b string, t string, n string, i string")
    rows = df.select(text.theme_tokens(F.col("a"), F.col("b")).alias("k"), text.record_time("t").alias("t"), text.number("n").alias("n"), text.integer("i").alias("i")).collect()
    assert [r.k for r in rows] == [["FLOOD", "TAX", "A"], [], ["X"]]
    assert [r.t for r in rows] == [datetime(2026, 8, 19, 12), None, None]
    assert [r.n for r in rows] == [-45.0, None, None] and [r.i for r in rows] == [3, None, 7]
    hour = spark.range(1).select(text.six_hours_of(F.lit("2026-08-19 17:59:00").cast("timestamp_ntz")).alias("h"))
    assert hour.first().h == datetime(2026, 8, 19, 12)


@pytest.mark.parametrize(("raw", "want"), [
    ("HTTPS://Example.COM:443//news/story/?b=2&utm_source=email&a=1#details", "https://example.com/news/story?a=1&b=2"), ("http://u:p@h.test:8080", "http://h.test:8080/"),
    ("https://bücher.test/ä?x=%C3%A4&y=", "https://xn--bcher-kva.test/ä?x=%C3%A4&y="), ("javascript:alert(1)", None), ("", None), (None, None), ("http://h:99999/", None), ("http:///x", None), ("https://[::1", None)])
def test_canonical(raw, want):
    assert urls.identity(raw)[0] == want


def test_slugs_and_groups(spark):
    long_ = "young-people-who-do-not-pass-gcse-english-and-maths"
    for u in (f"https://one.test/news/{long_}", f"https://two.test/2026/08/{long_}.html", f"https://x.test/{long_.upper()}.PHP/"):
        assert urls.identity(u)[2] == long_
    assert not any(urls.identity(u)[2] for u in ("https://example.test/news/latest", "https://example.test/", None))
    df = spark.createDataFrame([(long_, "2026-08-19 14:15:00", "id1"), (None, "2026-08-19 14:15:00", "id2"), (long_, None, "id3")], "slug string, t string, id string")
    g = [r.g for r in df.select(urls.story_group(F.col("slug"), text.six_hours_of(F.col("t").cast("timestamp_ntz")), F.lit("flood"), F.col("id")).alias("g")).collect()]
    assert [x.method for x in g] == ["url_slug_6h", "canonical_url", "canonical_url"] and [g[1].id, g[2].id] == ["id2", "id3"]


def chosen(spark, raws):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(raws)], "k long, raw string").withColumn("p", locations.parse_locations("raw"))
    df = df.withColumn("r", locations.ranked_regions(F.col("p"))).withColumn("s", locations.selection_status(F.col("p"), F.col("r")))
    return df.select("k", "p", F.col("r.region").alias("c"), "s", locations.distinct_places(F.col("p")).alias("n"), locations.primary_place(F.col("p"), F.col("s"), F.col("r")).alias("best")).orderBy("k").collect()


US, BATON = "1#United States#US#US##39#-98#US#10", "3#Baton Rouge#US#USLA#LA033#30.4#-91.1#2#40"
BIG, HAWAII = "4#Big Island#US#USNH##43#-71#5#5", "2#Hawaii#US#USHI##20#-157#6#{}"
DENVER = "3#Denver#US#USCO##39.7#-104.9#7#{}"


def test_places(spark):
    rows = chosen(spark, [
        f"{US};{BATON}", "2#Unknown#US#USXX##125#-190#-1#20", f"3#Edgewater#US#USCO##39.7#-105#8#10;{DENVER.format(20)};{DENVER.format(80)}", f"{BIG};{HAWAII.format(20)}", f"{BIG};{HAWAII.format(20)};{HAWAII.format(80)}", None, "1###", " ; "])
    assert [r.s for r in rows] == ["ambiguous_region", "single_region", "single_region", "ambiguous_region", "dominant_region", "missing", "unresolved_region", "missing"]
    assert rows[0].best.name == "Baton Rouge" and rows[0].best.adm2 == "LA033" and rows[0].best.valid and rows[0].n == 2
    assert rows[1].best.lat == 125 and not rows[1].best.valid
    assert rows[2].best.name == "Denver" and rows[2].n == 2
    assert rows[3].best.adm1 == "USNH" and rows[3].c == ["US:USHI", "US:USNH"]
    assert rows[4].best.adm1 == "USHI" and rows[4].c == ["US:USHI", "US:USNH"]
    assert rows[5].best is None and rows[6].best is not None


def plain_choice(raw):
    """The same rules, in plain Python."""
    num = lambda x: float(x) if x.strip().lstrip("-").replace(".", "", 1).isdigit() else None
    found = []
    for e in raw.split(";"):
        if e.strip():
            f = [x.strip() for x in (e.split("#") + [""] * 9)[:9]]
            lat, lon = num(f[5]), num(f[6])
            key = (int(f[0]) if f[0].isdigit() else None, f[1] or None, f[2].upper() or None, f[3].upper() or None, f[4].upper() or None, lat, lon, f[7] or None)
            found.append((key, int(f[8]) if f[8].isdigit() else None, lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180))
    region = lambda k: f"{k[2]}:{k[3]}" if k[2] and k[3] else k[2]
    names = [region(k) for k, *_ in found if region(k)]
    ranked = sorted(set(names), key=lambda r: (-names.count(r), r))
    if not found:
        return "missing", [], None
    status = "unresolved_region" if not ranked else "single_region" if len(ranked) == 1 else "dominant_region" if names.count(ranked[0]) >= 2 * names.count(ranked[1]) else "ambiguous_region"
    keys = [k for k, *_ in found]
    pool = [k for k in dict.fromkeys(keys) if status not in ("single_region", "dominant_region") or region(k) == ranked[0]]
    rank = lambda k: (next(v for q, _, v in found if q == k), {3: 4, 4: 4, 2: 3, 5: 3, 1: 2}.get(k[0], 1), keys.count(k), bool(k[1]), -min([o for q, o, _ in found if q == k and o is not None], default=10**12))
    return status, ranked, max(pool, key=rank)[:5]


FIELD = st.sampled_from
ENTRY = st.tuples(FIELD(["1", "2", "3", "4", "x", ""]), FIELD(["A", "b", ""]), FIELD(["us", "MX", ""]), FIELD(["US1", "us2", ""]), FIELD(["", "z"]), FIELD(["10", "99", "", "x"]), FIELD(["20", "-20"]), FIELD(["1", ""]), FIELD(["5", "7", "70", ""])).map("#".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(ENTRY | st.just(" ") | st.just("3#A"), max_size=6).map(";".join), min_size=20, max_size=40))
def test_places_against_plain_python(spark, raws):
    for raw, r in zip(raws, chosen(spark, raws), strict=True):
        best = r.best and (r.best.kind, r.best.name, r.best.country, r.best.adm1, r.best.adm2)
        assert (r.s, r.c, best) == plain_choice(raw)
