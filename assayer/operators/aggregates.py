"""Reports, comparisons, usage and ranking over long tables of scores, calls and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def report(scores: DataFrame, by: str = "metric_name") -> DataFrame:
    """Per metric: count, mean and population deviation of finite scores; all else are errors."""
    ok = F.when(finite(F.col("value")), F.col("value"))
    return scores.groupBy(by).agg(
        F.count(ok).alias("count"), F.coalesce(F.avg(ok), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(ok), F.lit(0.0)).alias("std"),
        F.sum(F.when(finite(F.col("value")), 0).otherwise(1)).alias("errors"),
    )


def metric_means(scores: DataFrame) -> DataFrame:
    """Mean over all values: one that is not a number makes the mean one too; failures are left out."""
    return scores.where(F.col("value").isNotNull()).groupBy("metric_name").agg(F.avg("value").alias("mean"))


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Candidate mean minus baseline mean per metric of either run; a missing mean is 0. The change in
    the number of samples is given by sample_count_delta."""
    a, b = metric_means(baseline).withColumnRenamed("mean", "a"), metric_means(candidate).withColumnRenamed("mean", "b")
    both = a.join(b, "metric_name", "full_outer")
    return both.select("metric_name", F.coalesce("a", F.lit(0.0)).alias("baseline"), F.coalesce("b", F.lit(0.0)).alias("candidate"), (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("delta"))


def sample_count_delta(baseline: DataFrame, candidate: DataFrame) -> int:
    count = lambda s: s.select("sample_index").distinct().count()
    return count(candidate) - count(baseline)


def summarize(scores: DataFrame, name: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """Mean per metric of one run, with its name and what is known about it."""
    known = F.create_map(*[F.lit(x) for kv in sorted((metadata or {}).items()) for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    return metric_means(scores).select(F.lit(name).alias("experiment"), "metric_name", "mean", known.alias("metadata"))


def estimated_cost(calls: DataFrame, input_rate: float, output_rate: float | None = None) -> DataFrame:
    """The cost of all calls at rates per token; the output rate defaults to the input rate."""
    out = input_rate if output_rate is None else output_rate
    return calls.agg(F.round(F.coalesce(F.sum("prompt_tokens"), F.lit(0)) * input_rate + F.coalesce(F.sum("completion_tokens"), F.lit(0)) * out, 12).alias("cost"))


def total_model_cost(calls: DataFrame, rates: DataFrame, per: int = 1) -> float:
    """The rounded sum of model_cost; a model without a rate is an error."""
    lacking = calls.select("model").distinct().join(rates, "model", "left_anti").first()
    if lacking:
        raise ValueError(f"no rate for model {lacking['model']}")
    return model_cost(calls, rates, per).agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 12)).first()[0]


def subset_of(a: Column, b: Column) -> Column:
    """Whether every value of array a is in array b."""
    return F.size(F.array_except(a, b)) == 0


def usage(calls: DataFrame) -> DataFrame:
    """Token sums overall, by provider and by metric, in one pass of grouping sets."""
    total = F.coalesce("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    return calls.groupingSets([[], ["provider"], ["metric_name"]], "provider", "metric_name").agg(
        F.grouping_id().alias("level"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(total).alias("total_tokens")
    )


def model_cost(calls: DataFrame, rates: DataFrame, per: int = 1) -> DataFrame:
    """Cost per model from rates (model, input_rate, output_rate) for ``per`` tokens; the output rate
    defaults to the input rate. Terms and totals are rounded to 1e-12."""
    sums = calls.groupBy("model").agg(F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"))
    r = sums.join(rates, "model", "left")
    out = F.coalesce("output_rate", "input_rate")
    return r.select("model", F.round(F.round(F.col("p") / per * F.col("input_rate"), 12) + F.round(F.col("c") / per * out, 12), 12).alias("cost"))


def frequent_items(items: DataFrame, share: float = 0.05, item: str = "item", position: str = "position") -> DataFrame:
    """The max(1, share of the distinct) most frequent items, ties by first position.

    The count of the last of them is read off a histogram of counts (a row per different count), so
    that all but the items of that very count are found by a filter; only ties are sorted."""
    counts = items.groupBy(item).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    histogram = [(r["n"], r["c"]) for r in counts.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).toLocalIterator()]
    k, above = max(1, int(sum(c for _, c in histogram) * share)), 0
    for n, c in histogram:
        if above + c >= k:
            ties = counts.where(F.col("n") == n)
            ties = ties if above + c == k else ties.orderBy("first", item).limit(k - above)
            return counts.where(F.col("n") > n).unionByName(ties)
        above += c
    return counts


def transform_branch(docs: DataFrame, chars: Column) -> DataFrame:
    """split, no_split or none, by the shares of long and middling documents."""
    long, middle = F.avg(F.when(chars > 2000, 1.0).otherwise(0.0)), F.avg(F.when((chars > 400) & (chars <= 2000), 1.0).otherwise(0.0))
    return docs.agg(long.alias("long_share"), middle.alias("middle_share")).withColumn("branch", F.when(F.col("long_share") >= 0.25, "split").when(F.col("middle_share") >= 0.25, "no_split").otherwise("none"))


def consecutive(rows: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """(source_id, target_id, order) of rows next to each other within a group."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.select(F.col(key).alias("source_id"), F.lead(key).over(w).alias("target_id"), F.col(order).alias("order")).where(F.col("target_id").isNotNull())


def multiset_match(a: DataFrame, b: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Clipped overlap of two row multisets per group: aggregated counts meet, never single rows."""
    x = a.groupBy(*by, *keys).agg(F.count("*").alias("na"))
    y = b.groupBy(*by, *keys).agg(F.count("*").alias("nb"))
    both = x.join(y, [*by, *keys], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.groupBy(*by).agg(F.sum(F.least(zero("na"), zero("nb"))).alias("hits"), F.sum(zero("na")).alias("left"), F.sum(zero("nb")).alias("right"))


def unpivot(scored: DataFrame, metrics: list[str], key: str = "sample_index") -> DataFrame:
    """One column per metric to rows (key, metric_index, metric_name, value)."""
    index = F.create_map(*[x for i, m in enumerate(metrics) for x in (F.lit(m), F.lit(i))])
    return scored.unpivot([key], metrics, "metric_name", "value").withColumn("metric_index", index[F.col("metric_name")])
