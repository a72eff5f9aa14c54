"""Scores over streams. This goes beyond batch evaluation: the native metrics are functions of a row,
so they run unchanged on a stream, and their report becomes a windowed aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.aggregates import finite


def windowed_report(scores: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Count, mean and errors per metric and tumbling window; rows later than the watermark are left out."""
    ok = F.when(finite(F.col("value")), F.col("value"))
    return scores.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "metric_name").agg(F.count(ok).alias("count"), F.avg(ok).alias("mean"), F.sum(F.when(finite(F.col("value")), 0).otherwise(1)).alias("errors")).select("w.start", "w.end", "metric_name", "count", "mean", "errors")
