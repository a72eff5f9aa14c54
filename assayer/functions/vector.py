"""Vector and score arithmetic as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or zero vectors and for different lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0)))


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def threshold(score: Column, at: float, inclusive: bool = True) -> Column:
    return ((score >= at) if inclusive else (score > at)).cast("double")


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v)).cast("float")
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("float") / norm).cast("float"))).otherwise(v)


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def normalized_score(c: Column, policy: str = "clamp") -> Column:
    """Clamped to [0, 1], or null outside it under "reject"; not a number is always null."""
    finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite, clamp(c)) if policy == "clamp" else F.when(finite & c.between(0, 1), c)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    d = 2 * tp + fp + fn
    return F.when(d > 0, 2 * tp / d).otherwise(F.lit(0.0))


def answer_correctness(semantic: Column, factual: Column, ws: float = 0.25, wf: float = 0.75) -> Column:
    return (clamp(semantic) * ws + factual * wf) / (ws + wf) if ws + wf > 0 else F.lit(0.0)


def noise_sensitivity(clean: Column, noisy: Column) -> Column:
    return F.greatest(F.lit(0.0), clamp(clean) - clamp(noisy))


def average_precision(verdicts: Column) -> Column:
    """Mean of precision at the places of verdict 1; 0 where there is none."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum"))

    def step(s: Column, v: Column) -> Column:
        hits = s["hits"] + F.when(v == 1, 1).otherwise(0)
        return F.struct((s["k"] + 1).alias("k"), hits.alias("hits"), (s["sum"] + F.when(v == 1, hits / (s["k"] + 1)).otherwise(F.lit(0.0))).alias("sum"))

    return F.aggregate(verdicts, start, step, lambda s: F.when(s["hits"] > 0, s["sum"] / s["hits"]).otherwise(F.lit(0.0)))
