"""Scoring samples by metrics: native ones in a single projection, staged ones joined to it."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import metrics as M
from assayer.functions import text as T
from assayer.operators.aggregates import unpivot



def _r() -> Column:
    return F.col("response")


def _g() -> Column:
    return F.col("reference")


def _has() -> Column:
    return ~T.is_blank(_g())


#: Metrics that need no provider, by name: columns over single-turn samples with a_tokens, b_tokens.
NATIVE: dict[str, Callable[[], Column]] = {
    "exact_match": lambda: F.when(_has(), T.exact_match(_r(), _g())),
    "string_presence": lambda: F.when(_has(), M.string_presence(_r(), _g())),
    "string_similarity": lambda: F.when(_has(), T.levenshtein_similarity(_r(), _g())),
    "bleu_score": lambda: F.when(_has(), T.bleu(F.col("a_tokens"), F.col("b_tokens"))),
    "chrf": lambda: F.when(_has(), T.chrf(_r(), _g())),
    "rouge_score": lambda: F.when(_g().isNotNull(), T.rouge(F.col("a_tokens"), F.col("b_tokens"))),
    "rouge_l": lambda: F.when(_g().isNotNull(), T.rouge_l_recall(F.col("a_tokens"), F.col("b_tokens"))),
    "non_llm_context_precision": lambda: M.context_precision(F.col("retrieved_contexts"), F.col("reference_contexts")),
    "non_llm_context_recall": lambda: M.context_recall(F.col("retrieved_contexts"), F.col("reference_contexts")),
    "id_based_context_precision": lambda: F.when(F.size("reference_context_ids") > 0, M.id_precision(F.col("retrieved_context_ids"), F.col("reference_context_ids"))),
    "id_based_context_recall": lambda: M.id_recall(F.col("retrieved_context_ids"), F.col("reference_context_ids")),
    "datacompy_score": lambda: F.when(_has(), M.table_overlap(M.csv_rows(_r()), M.csv_rows(_g()))),
    "lexical_context_recall": lambda: F.when(_has(), M.lexical_context_recall(_g(), F.col("retrieved_contexts"))),
    "lexical_groundedness": lambda: M.lexical_groundedness(_r(), F.col("retrieved_contexts")),
    "lexical_context_relevance": lambda: M.lexical_context_relevance(F.col("user_input"), F.col("retrieved_contexts")),
}


def evaluate(samples: DataFrame, metrics: dict[str, Column] | list[str], staged: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Rows (sample_index, metric_index, metric_name, value, error) for each sample and metric.

    metrics are names of NATIVE or columns of one's own; staged ones are functions from samples to
    (sample_index, value, error). Tokens are computed once per sample. A native metric that cannot be
    computed is an error, not a score.
    """
    columns = {m: resolve(m)() for m in metrics} if isinstance(metrics, list) else metrics
    d = samples.withColumn("a_tokens", T.ws_tokens(_r())).withColumn("b_tokens", T.ws_tokens(F.coalesce(_g(), F.lit(""))))
    out = None
    if columns:
        wide = d.select("sample_index", *[c.cast("double").alias(n) for n, c in columns.items()])
        out = unpivot(wide, list(columns)).withColumn("error", F.when(F.col("value").isNull(), F.lit("a required field is missing")))
    for i, (name, stage) in enumerate((staged or {}).items(), len(columns)):
        s = stage(samples).select("sample_index", F.lit(name).alias("metric_name"), "value", F.lit(i).alias("metric_index"), "error")
        out = s if out is None else out.unionByName(s)
    return out.select("sample_index", "metric_index", "metric_name", "value", "error")


def names() -> list[str]:
    """The metrics that need no provider, sorted."""
    return sorted(NATIVE)


def resolve(name: str) -> Callable[[], Column]:
    if name not in NATIVE:
        raise KeyError(f"no metric {name}; known: {', '.join(names())}")
    return NATIVE[name]


class MetricFailed(RuntimeError):
    """The first failure of a run, in the order of samples and metrics."""


def ordered(scores: DataFrame) -> DataFrame:
    """Cells in the order of samples and metrics."""
    return scores.orderBy("sample_index", "metric_index")


def fail_fast(scores: DataFrame) -> DataFrame:
    """scores, if no cell has failed; else an error that tells the first of them. One row is looked
    for, not the table sorted."""
    bad = scores.where("error is not null").agg(F.min(F.struct("sample_index", "metric_index", "metric_name", "error")).alias("e")).first()["e"]
    if bad:
        raise MetricFailed(f"sample {bad['sample_index']}, metric {bad['metric_name']}: {bad['error']}")
    return scores


def notify(scores: DataFrame, observers: list[Callable[[dict], None]]) -> None:
    """Tells observers of the run's events one after the other; an observer that raises is passed over."""
    for r in events(scores).orderBy("sample_index", "metric_index", F.col("kind") != "metric_started").toLocalIterator():
        for tell in observers:
            with contextlib.suppress(Exception):
                tell(r.asDict())


def in_order(tasks: list[Callable[[], object]], concurrency: int = 16, progress: Callable[[int, int], None] | None = None, raise_errors: bool = False) -> list:
    """Results of the driver's own tasks in their order, up to ``concurrency`` at a time; a failed one
    gives its exception, or with ``raise_errors`` raises the first. progress is told (done, all)."""
    done = 0
    with ThreadPoolExecutor(concurrency) as pool:
        futures = [pool.submit(t) for t in tasks]
        if progress:
            for _ in as_completed(futures):
                done += 1
                progress(done, len(tasks))
        out = [f.exception() or f.result() for f in futures]
    bad = next((x for x in out if isinstance(x, BaseException)), None)
    if raise_errors and bad is not None:
        raise bad
    return out


def write_report(rows: list, path: str) -> None:
    """One JSON file with a row per metric; what is not a number is null."""
    clean = [{k: None if isinstance(v, float) and v != v else v for k, v in r.asDict().items()} for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"metrics": sorted(clean, key=lambda r: r["metric_name"])}, f, indent=2, sort_keys=True)


def events(scores: DataFrame) -> DataFrame:
    """What an observer of the run would be told, as rows."""
    kind = F.when(F.col("error").isNull(), "metric_succeeded").otherwise("metric_failed")
    return scores.select("sample_index", "metric_index", "metric_name", F.explode(F.array(F.lit("metric_started"), kind)).alias("kind"))


def report_lines(rows: list) -> str:
    """A table of at most a row per metric."""
    head = f"{'metric':<24} {'count':>8} {'mean':>10} {'std':>10} {'errors':>8}"
    return "\n".join([head, *[f"{r['metric_name']:<24} {r['count']:>8} {r['mean']:>10.4f} {r['std']:>10.4f} {r['errors']:>8}" for r in rows]])
