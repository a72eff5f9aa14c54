"""Mixing sources to target weights by repeating whole documents.

Sizes (words) are summed per source. Each source gets a target size: its weight's share of the mix,
never above ``most`` times its own size; what a full source leaves over goes to the others by weight.
A document is emitted floor(target / size) times and once more with the fraction as probability,
drawn from a hash of its identity and a seed. Of ``draws`` seeds each source uses the one whose draw
comes nearest its target, so that small sources come near theirs too. Everything is DataFrame
aggregation; the rank of a source comes from a range partitioning, never from one task or the driver.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source, ordered last;
repeated rows draw alike; if all sizes are 0 all targets are 0; an empty table gives no rows; columns
whose names clash with those added are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_CLASS, Workspace


def word_count(text: Column) -> Column:
    """How many runs of other characters than white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def ranked(work: Workspace, table: DataFrame, key: str) -> DataFrame:
    """Adds ``rank``, from 0, in the order of key with nulls last, without sorting in one task."""
    parts = work.keep(table.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("part").count()  # a row per partition, not per key
    before = F.broadcast(sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before"))
    here = F.row_number().over(Window.partitionBy("part").orderBy(F.col(key).asc_nulls_last())) - 1
    return parts.withColumn("here", here).join(before, "part").withColumn("rank", F.col("before") + F.col("here")).drop("part", "here", "before")


def source_targets(work: Workspace, sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``weight`` and ``target`` to rows (source, source_size) by water filling: the level at
    which sources that reach ``most`` times their size stop is raised until none is above."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = work.keep(ranked(work, sources, "source").withColumn("weight", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))).drop("rank"), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        got = table.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (share * total - got[0]) / got[1] if got[1] else level
        if new <= level:
            break
        level = new
    return table.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, draws: int = 16) -> DataFrame:
    """Each row of docs with size, source_size, target, copies and taken (size times copies)."""
    work = Workspace(docs.sparkSession, "mixing")
    added = ("size", "source_size", "target", "copies", "taken", "weight", "best")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    sized = docs.withColumn("source", F.col("source").cast("string")).withColumn("size", word_count(F.col("text")))
    narrow = work.keep(sized.select("doc_id", "source", "size"), "sizes")
    table = work.keep(source_targets(work, narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def draw(k: Column | int) -> Column:
        unit = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed), F.lit(k) if isinstance(k, int) else k), F.lit(1 << 40)) / F.lit(float(1 << 40))
        return F.floor(rate) + F.when(unit < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))

    with_rate = _by_source(narrow, table)
    tries = with_rate.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(F.col("size") * draw(k)).alias(f"t{k}") for k in range(draws)])
    off = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(draws)])
    best = work.keep(tries.select("source", F.array_min(off)["k"].alias("best")), "seeds")
    table = work.keep(table.join(best, table["source"].eqNullSafe(best["source"])).drop(best["source"]), "final")
    return _by_source(sized, table).withColumn("copies", draw(F.col("best")).cast("long")).withColumn("taken", F.col("size") * F.col("copies")).drop("weight", "best")


def _by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of table. Rows of any one source stay in as many tasks as read them:
    the table travels, by broadcast if it has few sources, else to salted keys."""
    n = table.count()
    if n <= 10_000:  # a source takes under 1 KB
        t = F.broadcast(table.withColumnRenamed("source", "_s"))
        return rows.join(t, rows["source"].eqNullSafe(t["_s"])).drop("_s")
    salts = 64
    t = table.withColumnRenamed("source", "_s").withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    r = rows.withColumn("_r", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return r.join(t, r["source"].eqNullSafe(t["_s"]) & (r["_r"] == t["_t"])).drop("_s", "_t", "_r")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row once per copy, numbered from 0 in ``copy``."""
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
