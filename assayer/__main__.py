"""Command line: evaluate samples, make test sets, time providers, show the configuration.

    python -m assayer evaluate DATA [--metrics a,b] [--columns canonical=name,...] [--report FILE] [--fail-fast]
    python -m assayer testset TEXTS --output DIR [--bytes N]
    python -m assayer benchmark DATA [--runs N]
    python -m assayer config [--env FILE]

Prints JSON with sorted keys; errors go to standard error as JSON with their kind, and end with 2 for a
wrong call and 1 for all else.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayer.operators.aggregates import report
from assayer.plans.evaluate import evaluate, fail_fast, report_lines, write_report
from assayer.plans.providers import HttpProvider, ProviderConfig, stored
from assayer.plans.testset import document_graph, template_samples
from assayer.plans.transforms import generate_testset
from assayer.sources.datasets import DatasetError, checked_csv, checked_jsonl, validated, write_jsonl


def column_map(text: str) -> dict[str, str]:
    """canonical=name pairs between commas."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        canonical, eq, actual = (x.strip() for x in part.partition("="))
        if not eq or not canonical or not actual:
            raise DatasetError(f"a column is given as canonical=name, not {part}")
        out[canonical] = actual
    return out


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("assayer").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _samples(spark: SparkSession, path: str, columns: str):
    read = checked_csv if path.endswith(".csv") else checked_jsonl
    return validated(read(spark, path, column_map(columns)))


def run_evaluate(a: argparse.Namespace) -> dict:
    scores = evaluate(_samples(_session(), a.data, a.columns), a.metrics.split(","))
    if a.fail_fast:
        fail_fast(scores)
    rows = report(scores).orderBy("metric_name").collect()
    print(report_lines(rows), file=sys.stderr)
    if a.report:
        write_report(rows, a.report)
    return {"metrics": {r["metric_name"]: {k: r[k] for k in ("count", "errors", "mean", "std")} for r in rows}}


def run_testset(a: argparse.Namespace) -> dict:
    """With a key for a model its questions and answers, else samples by template."""
    spark = _session()
    name = F.element_at(F.split("file", "/"), -1)
    docs = spark.read.option("wholetext", True).text(a.texts).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file")).select(name.alias("doc_id"), "text")
    config = ProviderConfig.load(dict(os.environ), a.env)
    if config.api_key:
        made = generate_testset(docs, HttpProvider(config.base_url, config.model, config.api_key), stored(a.output + "/stages"), a.bytes)
    else:
        made = template_samples(*document_graph(docs, a.bytes))
    write_jsonl(made, a.output + "/samples")
    return {"samples": spark.read.text(a.output + "/samples").count(), "path": a.output + "/samples"}


def run_benchmark(a: argparse.Namespace) -> dict:
    """Samples a second of all native text metrics, measured."""
    samples = _samples(_session(), a.data, a.columns)
    n, took = samples.count(), []
    for _ in range(a.runs):
        began = time.perf_counter()
        evaluate(samples, a.metrics.split(",")).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return {"runs": a.runs, "samples": n, "best_seconds": round(min(took), 3), "samples_per_second": round(n / min(took), 3)}


def run_config(a: argparse.Namespace) -> dict:
    return ProviderConfig.load(dict(os.environ), a.env).shown()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assayer")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in (("evaluate", run_evaluate), ("benchmark", run_benchmark)):
        c = sub.add_parser(name)
        c.add_argument("data")
        c.add_argument("--metrics", default="exact_match,rouge_l,string_similarity")
        c.add_argument("--columns", default="")
        c.set_defaults(run=run)
        if name == "evaluate":
            c.add_argument("--report")
            c.add_argument("--fail-fast", action="store_true")
        else:
            c.add_argument("--runs", type=int, default=1)
    c = sub.add_parser("testset")
    c.add_argument("texts")
    c.add_argument("--output", required=True)
    c.add_argument("--bytes", type=int, default=256)
    c.add_argument("--env", default=".env")
    c.set_defaults(run=run_testset)
    c = sub.add_parser("config")
    c.add_argument("--env", default=".env")
    c.set_defaults(run=run_config)
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        print(json.dumps(a.run(a), sort_keys=True))
    except Exception as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)[:500]}, sort_keys=True), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
