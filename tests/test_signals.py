"""Features, history, anomalies, reviews, evidence, downloads and the incremental refresh."""

import io
import json
import statistics
import zipfile
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch import cli
from tidewatch.operators import anomalies, evidence, features, reports
from tidewatch.plans import catalogue
from tidewatch.schemas import FEATURE_COLUMNS, GKG_FIELDS
from tidewatch.sources import downloads, tables
from tidewatch.streaming import refresh

SMALL = "/root/testdata/sf0.001"
DAY = datetime(2026, 8, 20)
ARTICLE = "seen_at timestamp_ntz, country_code string, adm1_code string, disaster_type string, source_domain string, duplicate_group_id string, disaster_match_strength string, tone double"


def at(h, m=0):
    return DAY + timedelta(hours=h, minutes=m)


def test_features(spark):
    rows = [(at(12), "US", "USLA", "flood", "one.test", "story-1", "high", -2.0), (at(12, 15), "US", "USLA", "flood", "two.test", "story-1", "high", -4.0),
            (at(12, 30), "US", "USLA", "flood", "three.test", "story-2", "weak", -3.0), (at(13), "US", "USLA", "flood", "four.test", "story-3", "weak", -1.0), (None, "US", "USLA", "flood", "x", "y", "high", 0.0)]
    out = features.build_features(spark.createDataFrame(rows, ARTICLE))
    assert out.columns == FEATURE_COLUMNS
    a, b = out.orderBy("window_start").collect()
    assert (a.region_id, a.article_count, a.estimated_unique_story_count, a.high_confidence_story_count, a.article_velocity, a.average_tone) == ("US:USLA", 3, 2, 1, None, -3.0)
    assert a.duplicate_ratio == pytest.approx(1 / 3)
    assert (b.high_confidence_article_count, b.weak_article_count, b.article_velocity, b.domain_velocity) == (0, 1, -1, -2)


def test_uncertain_regions(spark):
    rows = [(at(12), "US", "USNH", "flood", "a", "g1", "high", None, "ambiguous_region"), (at(12), "US", "USHI", "flood", "b", None, "high", 1.0, "single_region"), (at(12), "US", None, "flood", None, None, "weak", 1.0, "dominant_region")]
    got = {r.region_id: r for r in features.build_features(spark.createDataFrame(rows, ARTICLE + ", location_selection_status string")).collect()}
    assert got["UNKNOWN"].country_code is None and (got["UNKNOWN"].location_review_article_count, got["UNKNOWN"].location_confident_article_count) == (1, 0)
    assert (got["US:USHI"].location_review_article_count, got["US:USHI"].location_confident_article_count, got["US:USHI"].high_confidence_story_count) == (0, 1, 1)
    assert (got["US"].unique_domain_count, got["US"].estimated_unique_story_count, got["US"].high_confidence_story_count) == (0, 1, 0)
    with pytest.raises(ValueError):
        features.build_features(spark.createDataFrame(rows, ARTICLE + ", location_selection_status string").drop("tone"))


HISTORY = "window_start timestamp_ntz, region_id string, disaster_type string, unique_domain_count long, estimated_unique_story_count long, previous_story_count long, previous_domain_count long, article_velocity long, domain_velocity long"


def batch(spark, *rows):
    return spark.createDataFrame([(at(h), r, "flood", n, n, None, None, None, None) for h, r, n in rows], HISTORY)


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    tables.update_history(spark, batch(spark, (12, "US:USHI", 2), (12, "UNKNOWN", 4)), path)
    stats = tables.update_history(spark, batch(spark, (12, "US:USHI", 5), (13, "US:USHI", 3)), path)
    assert (stats["replaced_rows"], stats["history_rows"], stats["existing_rows"]) == (2, 2, 2)
    rows = spark.read.parquet(path).orderBy("window_start").collect()
    assert [r.estimated_unique_story_count for r in rows] == [5, 3] and [r.previous_story_count for r in rows] == [None, 5]
    assert [r.article_velocity for r in rows] == [r.domain_velocity for r in rows] == [None, -2]
    assert [p.name for p in tmp_path.iterdir()] == ["history"]
    with pytest.raises(ValueError):
        features.merge_history(spark.read.parquet(path), batch(spark, (14, "x", 1)).drop("article_velocity"))
    with pytest.raises(ValueError):
        features.merge_history(None, batch(spark).drop("region_id"))


FEATURE = "window_start timestamp_ntz, region_id string, country_code string, adm1_code string, disaster_type string, article_count long, estimated_unique_story_count long, high_confidence_story_count long, unique_domain_count long"


def series(spark, *rows, articles=None):
    return spark.createDataFrame([(at(h), "US:USHI", "US", "USHI", "flood", articles or s, s, s, d) for h, s, d in rows], FEATURE)


@pytest.mark.parametrize("lookback", [4, 60])
def test_scores(spark, lookback):
    few = anomalies.score(series(spark, (0, 1, 1), (1, 8, 8)), lookback_hours=lookback, minimum_history_hours=3).collect()
    assert [r.anomaly_status for r in few] == ["insufficient_history"] * 2
    got = anomalies.score(series(spark, (0, 0, 0), (3, 5, 5)), lookback_hours=lookback, minimum_history_hours=3).orderBy("window_start").collect()
    assert len(got) == 4 and sum(r.observed_feature_row for r in got) == 2 and sum(r.is_candidate_anomaly for r in got) == 1
    assert (got[3].baseline_median, got[3].baseline_mad, got[3].robust_z_score, got[3].baseline_history_hours) == (0, 0, None, 3)
    weak = anomalies.score(series(spark, (0, 0, 0), (3, 1, 8), articles=40), lookback_hours=lookback, minimum_history_hours=3).orderBy("window_start").collect()
    assert (weak[3].anomaly_status, weak[3].article_count) == ("below_minimum_support", 40)
    assert anomalies.score(series(spark), lookback_hours=lookback, minimum_history_hours=3).count() == 0


def test_score_guards(spark):
    for bad in ({"minimum_history_hours": 0}, {"lookback_hours": 5}, {"z_threshold": 0}, {"minimum_stories": 0}):
        with pytest.raises(ValueError):
            anomalies.score(series(spark), **bad)
    with pytest.raises(ValueError):
        anomalies.score(series(spark, (0, 1, 1), (0, 2, 2)))
    mixed = series(spark, (0, 1, 1)).unionByName(series(spark, (1, 1, 1)).withColumn("adm1_code", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        anomalies.score(mixed)


def test_rolling_baseline():
    x = np.random.default_rng(1).poisson(2, 90).tolist()
    count, median, mad = anomalies.rolling_baseline(x, 13, 5)
    for t in range(90):
        h = x[max(0, t - 13) : t]
        assert count[t] == len(h)
        if len(h) < 5:
            assert np.isnan(median[t])
        else:
            m = statistics.median(h)
            assert (median[t], mad[t]) == (m, statistics.median(abs(v - m) for v in h))


def silver_rows(spark, rows):
    base = dict.fromkeys(reports.REVIEW_COLUMNS)
    schema = ", ".join(f"{c} " + ("timestamp_ntz" if c == "seen_at" else "array<string>" if c in ("matched_disaster_themes", "location_candidate_regions", "quality_flags") else "long" if c in ("distinct_location_count", "duplicate_group_size") else "string") for c in base)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)


def test_review_sample(spark, tmp_path):
    rows = [{"article_id": "a", "seen_at": at(1), "disaster_match_strength": "high", "location_selection_status": "single_region", "quality_flags": ["x"]}, {"article_id": "b", "disaster_match_strength": "weak", "location_selection_status": "ambiguous_region"}]
    sample = reports.review_sample(silver_rows(spark, rows))
    assert [r.review_bucket for r in sample.collect()] == ["high:assigned_location", "weak:needs_location_review"]
    sheet = reports.review_csv(sample).collect()
    assert sheet[0].label_primary_region == "" and json.loads(sheet[0].quality_flags) == ["x"] and sheet[1].quality_flags == "[]" and sheet[1].seen_at == ""
    tables.write_sheet(reports.review_csv(sample), str(tmp_path / "s"))
    assert tables.read_sheet(spark, str(tmp_path / "s"), ["review_bucket"]).count() == 2
    with pytest.raises(ValueError):
        tables.read_sheet(spark, str(tmp_path / "s"), ["none"])
    with pytest.raises(ValueError):
        reports.review_sample(silver_rows(spark, rows), 0)


def test_scorecard(spark):
    cols = "disaster_match_strength string, location_selection_status string, country_code string, adm1_code string, label_disaster_relevance string, label_primary_region string"
    rows = [("high", "single_region", "US", "USHI", "relevant", "us:ushi"), ("high", "ambiguous_region", "US", "USNH", " Relevant", "US:USHI"), ("weak", "missing", "", None, "not_relevant", "UNKNOWN"), ("weak", "dominant_region", "UK", "UK", "relevant", "uncertain")]
    got = reports.scorecard(spark.createDataFrame(rows, cols))
    assert got["relevance"]["overall_relevance_rate"] == 0.75 and got["relevance"]["by_match_strength"]["high"]["relevance_rate"] == 1.0 and got["relevance"]["by_match_strength"]["weak"]["relevance_rate"] == 0.5
    assert (got["primary_region"]["labeled_rows"], got["primary_region"]["uncertain_rows"], got["primary_region"]["accuracy"]) == (3, 1, pytest.approx(2 / 3))
    assert reports.scorecard(spark.createDataFrame([], cols))["relevance"]["overall_relevance_rate"] is None
    with pytest.raises(ValueError):
        reports.scorecard(spark.createDataFrame([(*rows[0][:4], "perhaps", "")], cols))


def test_review_log(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.save_review(path, "US:USHI", "2026-08-20T19:00:00", "confirmed_event", spark)
    tables.save_review(path, "US:USHI", "2026-08-20T19:00:00", "uncertain", spark)
    got = tables.latest_reviews(spark, path).collect()
    assert [(r.signal_id, r.decision) for r in got] == [("US:USHI|2026-08-20T19:00:00", "uncertain")]
    for bad in (("US USHI", "2026-08-20T19:00:00", "uncertain"), ("US", "2026-08-20", "uncertain"), ("US", "2026-08-20T19:00:00", "maybe"), (None, "2026-08-20T19:00:00", "uncertain")):
        with pytest.raises(ValueError):
            tables.save_review(path, *bad, spark)
    signals = spark.createDataFrame([("US:USHI", "2026-08-20T19:00:00", "candidate_anomaly"), ("x", "y", "normal")], "code string, window_start string, status string")
    assert [r.decision for r in reports.reviewed_signals(signals, tables.latest_reviews(spark, path)).collect()] == ["uncertain"]


def scores(spark, rows):
    cols = "window_start timestamp_ntz, region_id string, disaster_type string, high_confidence_story_count long, unique_domain_count long, baseline_median double, robust_z_score double, anomaly_status string, is_candidate_anomaly boolean"
    return spark.createDataFrame(rows, cols)


REPORT = {"status_counts": [{"anomaly_status": "normal", "row_count": 1}], "candidate_anomalies": 1, "regions": 2, "hourly_windows": 1, "scored_rows": 2, "parameters": {}}


def test_snapshot(spark, tmp_path):
    clean = "seen_at timestamp_ntz, country_code string, adm1_code string, location_selection_status string, canonical_url string, source_domain string, duplicate_group_id string, disaster_match_strength string, matched_disaster_themes array<string>, location_name string"
    rows = [(at(19, m), None, None, "missing", u, d, g, "high", ["FLOOD", " "], None) for m, u, d, g in ((0, "https://one.test/a", "x", "g1"), (5, "https://two.test/b", "y", "g1"), (9, "javascript:alert(1)", "z", "g2"))]
    articles = spark.createDataFrame(rows, clean)
    f = spark.createDataFrame([(at(18), 4, 2), (at(19), 5, 3)], "window_start timestamp_ntz, article_count long, estimated_unique_story_count long")
    s = scores(spark, [(at(19), "US:USHI", "flood", 5, 5, 4.0, 0.2248, "normal", False), (at(19), "UNKNOWN", "flood", 6, 6, 1.0, 7.25, "candidate_anomaly", True)])
    got = evidence.snapshot(articles, f, s, REPORT)
    assert (got["snapshot"]["clean_articles"], got["snapshot"]["story_groups"], got["snapshot"]["updated_label"], got["snapshot"]["window_label"]) == (9, 5, "Aug 20, 19:00 UTC", "Aug 20–20, 2026")
    assert [x["code"] for x in got["signals"]] == ["UNKNOWN"] and got["signals"][0]["region"] == "Unknown region" and got["status_counts"]["candidate_anomaly"] == 1
    story = got["signals"][0]["evidence"]
    assert len(story) == 1 and [x["domain"] for x in story[0]["sources"]] == ["one.test", "two.test"] and story[0]["themes"] == ["FLOOD"]
    # Without the columns for evidence, the earlier snapshot's is kept, with its unsafe sources removed.
    earlier = json.loads(json.dumps(got))
    earlier["signals"][0]["evidence"][0]["sources"] = [{"domain": "spoofed.test", "url": "https://one.test/a"}, {"domain": "d", "url": "javascript:x"}]
    again = evidence.snapshot(articles.drop("tone", "location_name"), f, s, REPORT, earlier)
    assert again["signals"][0]["evidence"][0]["sources"] == [{"domain": "one.test", "url": "https://one.test/a"}]
    assert evidence.earlier_evidence({"signals": [None, {"code": 1}, {"code": "a", "window_start": "b", "evidence": [1, {"sources": []}]}]}) == {}
    path = str(tmp_path / "d" / "s.json")
    evidence.write_json(again, path)
    assert evidence.signals_view(path)["signals"] == again["signals"] and [p.name for p in (tmp_path / "d").iterdir()] == ["s.json"]
    evidence.write_json({"signals": []}, path)
    with pytest.raises(ValueError):
        evidence.load_snapshot(path)
    normal = evidence.selected_signals(s.where("not is_candidate_anomaly"))
    assert [r.region_id for r in normal.collect()] == ["US:USHI"]
    first = evidence.selected_signals(scores(spark, [(at(1), "a", "flood", 1, 1, 0.0, 9.0, "candidate_anomaly", True), (at(1), "b", "flood", 1, 1, 0.0, None, "candidate_anomaly", True)]))
    assert [r.region_id for r in first.collect()] == ["b", "a"]
    assert evidence.rounded(2.675) == 2.67 and evidence.rounded(None) is None


def test_downloads(spark, tmp_path):
    last = "http://feed.test/v2/20260820120000.gkg.csv.zip"
    assert [u[-26:-12] for u in downloads.window_urls(last, 3)] == ["20260820113000", "20260820114500", "20260820120000"]
    assert len(downloads.window_urls(last, 672)) == 672
    for bad in ((last, 0), (last, 673), ("http://feed.test/x.zip", 1)):
        with pytest.raises(ValueError):
            downloads.window_urls(*bad)
    assert downloads.latest_url("1 a http://f/x.export.zip\n2 b " + last + "\n3 c http://f/later.gkg.csv.zip") == last
    with pytest.raises(ValueError):
        downloads.latest_url("nothing")
    fetch = lambda url, timeout: io.BytesIO(url.encode())
    folder = str(tmp_path / "raw")
    first = downloads.download_window(downloads.window_urls(last, 3), folder, workers=2, fetch=fetch)
    again = downloads.download_window(downloads.window_urls(last, 3), folder, fetch=fetch)
    assert (first["downloaded"], again["already_present"]) == (3, 3)
    assert len((tmp_path / "raw" / "manifest.jsonl").read_text().splitlines()) == 3
    digests = {r.sha256 for r in downloads.file_digests(spark, f"{folder}/*.zip").collect()}
    assert downloads.sha256_of(f"{folder}/20260820120000.gkg.csv.zip") in digests

    def broken(url, timeout):
        raise OSError("gone")

    with pytest.raises(OSError):
        downloads.download_window(downloads.window_urls(last, 5), folder, fetch=broken)
    assert not [p for p in (tmp_path / "raw").iterdir() if p.suffix == ".partial"]
    assert downloads.prune(folder, 2) == ["20260820113000.gkg.csv.zip"]


def record_file(folder, stamp, rows):
    with zipfile.ZipFile(folder / f"{stamp}.gkg.csv.zip", "w") as z:
        lines = []
        for k, (time, place) in enumerate(rows):
            r = dict.fromkeys(GKG_FIELDS, "") | {"GKGRECORDID": f"{stamp}-{k}", "V2.1DATE": time, "V2DOCUMENTIDENTIFIER": f"https://s{k}.test/{time}/{k}", "V2ENHANCEDTHEMES": "FLOOD,1", "V2ENHANCEDLOCATIONS": place}
            lines.append("\t".join(r.values()))
        z.writestr("x.gkg.csv", "\n".join(lines) + "\n")


def test_refresh_equals_batch(spark, tmp_path):
    raw, state = tmp_path / "raw", str(tmp_path / "state")
    raw.mkdir()
    hawaii = "2#Hawaii#US#USHI##20#-157#6#1"
    record_file(raw, "20260820120000", [("20260820120100", hawaii), ("20260820120200", hawaii), ("20260820130100", "")])
    refresh.run_refresh(spark, str(raw), state, lookback_hours=3, minimum_history_hours=1)
    record_file(raw, "20260820110000", [("20260820120500", hawaii), ("20260820140100", hawaii)])  # late, under an early name
    record_file(raw, "20260820140000", [("20260820120100", hawaii)])  # an article that is known
    got = refresh.run_refresh(spark, str(raw), state, lookback_hours=3, minimum_history_hours=1)
    from tidewatch.operators import silver
    from tidewatch.sources import gkg

    every = features.build_features(silver.silver(gkg.read_gkg(spark, str(raw), "*.zip")))
    rows = lambda df: sorted(map(str, df.select(*FEATURE_COLUMNS).collect()))
    assert rows(got) == rows(every) and got.count() == 3
    assert spark.read.parquet(f"{state}/scores").count() == 6


def test_streaming_counts(spark, tmp_path):
    rows = catalogue.articles(spark, SMALL)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, (df, mode) in enumerate(((refresh.streaming_hourly_counts(stream, "60 days"), "complete"), (refresh.streaming_dedup(stream, "60 days"), "append"))):
        q = df.writeStream.format("memory").queryName(f"out{k}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = rows.groupBy(F.date_trunc("hour", "seen_at").cast("timestamp_ntz").alias("window_start"), "disaster_type").agg(F.count(F.lit(1)).alias("article_count"))
    assert sorted(map(str, spark.table("out0").collect())) == sorted(map(str, want.collect()))
    assert spark.table("out1").count() == rows.select("article_id").distinct().count()


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "get_session", lambda *a: spark)
    raw = tmp_path / "raw"
    raw.mkdir()
    record_file(raw, "20260820120000", [(f"202608201{h}0100", "2#Hawaii#US#USHI##20#-157#6#1") for h in range(5)])
    out = lambda name: str(tmp_path / name)

    def run(*args):
        assert cli.main(list(args)) == 0
        text = capsys.readouterr().out
        return json.loads(text[text.index("{") :])

    assert run("batch-clean", "--input", str(raw), "--output", out("silver"))["output_rows"] == 5
    assert run("clean-gkg", "--input", str(raw / "20260820120000.gkg.csv.zip"), "--output", out("one"))["input_files"] == 1
    assert run("hourly-counts", "--input", out("silver"), "--csv", out("csv"))["rows"] == 5
    assert run("inspect-clean", "--input", out("silver"))["row_count"] == 5
    assert run("build-features", "--input", out("silver"), "--output", out("features"))["feature_rows"] == 5
    assert run("inspect-features", "--input", out("features"))["regions"] == 1
    assert run("merge-feature-history", "--input", out("features"), "--history", out("history"))["history_rows"] == 5
    assert run("score-anomalies", "--input", out("history"), "--output", out("scores"), "--report", out("report.json"), "--lookback-hours", "4", "--minimum-history-hours", "2")["scored_rows"] == 5
    assert run("build-review-set", "--input", out("silver"), "--output", out("review"))["review_rows"] == 5
    assert run("evaluate-review", "--input", out("review"))["review_rows"] == 5
    assert run("export-dashboard", "--clean", out("silver"), "--features", out("features"), "--anomalies", out("scores"), "--report", out("report.json"), "--output", out("snap.json"))["signals"] >= 0
    assert evidence.load_snapshot(out("snap.json"))["snapshot"]["clean_articles"] == 5
    assert run("run-refresh", "--input", str(raw), "--state", out("state"), "--keep", "1")["history_rows"] == 5


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("events", "labels", "documents", "conversations", "pages", "part", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(catalogue.ORACLES[name]).df()
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()[want.columns]
    value = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float, np.number)) else str(v)
    rows = lambda df: sorted(str(tuple(map(value, r))) for r in df.itertuples(index=False))
    assert rows(got) == rows(want)
