"""Command line: python -m tidewatch COMMAND --option value ...; every command prints a JSON object."""

from __future__ import annotations

import argparse
import json
import sys

from tidewatch.functions.text import HAZARDS, STRENGTHS
from tidewatch.operators import anomalies, evidence, features, reports, silver
from tidewatch.session import get_session
from tidewatch.sources import downloads, gkg, tables
from tidewatch.streaming import refresh


def _clean(spark, a, paths: list[str]) -> dict:
    records = gkg.read_gkg(spark, paths).persist()
    table = silver.silver(records, a.disaster, a.minimum_strength)
    tables.write_table(silver.in_order(table), a.output)
    out = silver.counters(records, spark.read.parquet(a.output), len(paths), a.disaster, a.minimum_strength)
    records.unpersist()
    return out | {"output": a.output}


def clean_gkg(spark, a) -> dict:
    return _clean(spark, a, [a.input])


def batch_clean(spark, a) -> dict:
    return _clean(spark, a, gkg.find_inputs(a.input, a.pattern))


def hourly_counts(spark, a) -> dict:
    counts = features.hourly_counts(spark.read.parquet(a.input))
    counts.show(truncate=False)
    if a.csv:
        tables.write_sheet(counts, a.csv)
    return {"rows": counts.count()}


def build_features(spark, a) -> dict:
    articles = spark.read.parquet(a.input)
    tables.write_table(features.build_features(articles).orderBy("window_start", "region_id", "disaster_type"), a.output)
    return features.feature_stats(articles, spark.read.parquet(a.output)) | {"output": a.output}


def merge_feature_history(spark, a) -> dict:
    return tables.update_history(spark, spark.read.parquet(a.input), a.history) | {"history": a.history}


def score_anomalies(spark, a) -> dict:
    rows = spark.read.parquet(a.input)
    p = {k: getattr(a, k) for k in anomalies.DEFAULTS}
    tables.replace_table(anomalies.score(rows, **p), a.output)
    scored = spark.read.parquet(a.output)
    stats = anomalies.anomaly_stats(rows, scored)
    if a.report:
        top = [r.asDict() | {"window_start": r.window_start.isoformat()} for r in anomalies.top_candidates(scored).collect()]
        counts = [r.asDict() for r in anomalies.status_counts(scored).collect()]
        evidence.write_json({"input": a.input, "output": a.output, "parameters": p} | stats | {"status_counts": counts, "top_candidate_anomalies": top}, a.report)
    return stats | {"output": a.output}


def inspect_clean(spark, a) -> dict:
    return {"input": a.input} | reports.quality_report(spark.read.parquet(a.input), max(a.top, 1))


def inspect_features(spark, a) -> dict:
    return {"input": a.input} | reports.feature_report(spark.read.parquet(a.input), max(a.top, 1))


def build_review_set(spark, a) -> dict:
    articles = spark.read.parquet(a.input)
    sample = reports.review_sample(articles, a.size).persist()
    tables.write_sheet(reports.review_csv(sample), a.output)
    strength = [r.disaster_match_strength for r in sample.collect()]
    review = sample.where(sample.location_selection_status.isin(reports.REVIEW)).count()
    return {"input_rows": articles.count(), "review_rows": len(strength), "high_strength_rows": strength.count("high"), "weak_strength_rows": strength.count("weak"), "location_review_rows": review, "output": a.output}


def evaluate_review(spark, a) -> dict:
    need = ["disaster_match_strength", "location_selection_status", "country_code", "adm1_code", *reports.LABEL_COLUMNS[:2]]
    return {"input": a.input} | reports.scorecard(tables.read_sheet(spark, a.input, need))


def export_dashboard(spark, a) -> dict:
    read = spark.read.parquet
    with open(a.report, encoding="utf-8") as f:
        report = json.load(f)
    found = evidence.snapshot(read(a.clean), read(a.features), read(a.anomalies), report, evidence.read_snapshot_or_none(a.output))
    evidence.write_json(found, a.output)
    return {"output": a.output, "signals": len(found["signals"])}


def download_history(spark, a) -> dict:
    latest = a.latest or downloads.latest_url(downloads.urlopen(a.index, timeout=30).read().decode())
    return downloads.download_window(downloads.window_urls(latest, a.files), a.output, a.manifest, a.workers)


def run_refresh(spark, a) -> dict:
    history = refresh.run_refresh(spark, a.input, a.state, a.disaster, a.minimum_strength)
    return {"history_rows": history.count(), "pruned": len(downloads.prune(a.input, a.keep)) if a.keep else 0}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewatch", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(f, *required: str, **optional):
        p = sub.add_parser(f.__name__.replace("_", "-"))
        for r in required:
            p.add_argument(f"--{r}", required=True)
        for name, value in optional.items():
            p.add_argument("--" + name.replace("_", "-"), default=value, type=type(value) if value is not None else str)
        p.set_defaults(run=f)
        return p

    for p in (add(clean_gkg, "input", "output"), add(batch_clean, "input", "output", pattern="*.zip"), add(run_refresh, "input", "state", keep=0)):
        p.add_argument("--disaster", choices=sorted(HAZARDS), default="flood")
        p.add_argument("--minimum-strength", choices=sorted(STRENGTHS), default="high")
    add(hourly_counts, "input", csv=None)
    add(build_features, "input", "output")
    add(merge_feature_history, "input", "history")
    add(score_anomalies, "input", "output", report=None, **anomalies.DEFAULTS)
    add(inspect_clean, "input", top=10)
    add(inspect_features, "input", top=10)
    add(build_review_set, "input", "output", size=40)
    add(evaluate_review, "input")
    add(export_dashboard, "clean", "features", "anomalies", "report", "output")
    add(download_history, "output", index="", latest=None, files=8, workers=8, manifest=None)
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = get_session("local[*]")
    print(json.dumps(a.run(spark, a), indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
