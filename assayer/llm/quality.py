"""Quality rules: learned decision lists over text statistics, in DataFrame operations only.

Statistics are native expressions over the whole text. From labelled rows (at most ``most_labels``,
those with the least hashes of their ids) sequential covering learns an ordered list of rules that
reject: it grows a conjunction of thresholds on one half of the rows, prunes it on the other, keeps
it if its precision there is high enough, takes away what it covers, and goes on. The list becomes
one conditional Spark expression.

Defined cases: a null text has no words; documents under ``least_words`` words or with over 30 % of
their words in repeated windows fail the base; without labels (null, empty or of one kind) nothing is
learned and the base decides; ties between thresholds go to the earlier statistic and the lower
threshold; repeated rows get equal verdicts; an empty table gives no rows; columns of docs that have the
name of one that is added (in any case of letters) are replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

WINDOW = 8
_SPACES = " \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share", "digit_share", "word_variety"]


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds to each row the columns of BASE and STATISTICS (prefixed with q_)."""
    added = {f"q_{c}" for c in BASE + STATISTICS}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    p = "_q"  # of working columns, unlike all others
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.withColumn(f"{p}_text", t)
    one = one.withColumn(f"{p}_w", F.filter(F.split(f"{p}_text", SPACE_CLASS + "+"), lambda x: x != ""))
    lines = F.filter(F.split(f"{p}_text", "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    one = one.withColumn(f"{p}_lines", lines).withColumn(f"{p}_n", F.size(f"{p}_w"))
    # Hashes of windows of 8 words from those of 4, of 2, and of words, each made once.
    one = one.withColumn(f"{p}_g1", F.when(F.col(f"{p}_n") > WINDOW, F.transform(f"{p}_w", lambda x: F.xxhash64(x))))
    for n in (1, 2, 4):
        shifted = F.slice(f"{p}_g{n}", n + 1, F.size(f"{p}_g{n}") - n)
        one = one.withColumn(f"{p}_g{2 * n}", F.slice(F.zip_with(f"{p}_g{n}", shifted, lambda x, y: F.xxhash64(x, y)), 1, F.size(f"{p}_g{n}") - n))
    one = one.withColumn(f"{p}_g", F.col(f"{p}_g8"))
    one = one.withColumn(f"{p}_twice", F.size(F.array_distinct(f"{p}_g")) < F.size(f"{p}_g"))
    # Only texts with a repeated window are sorted: windows by hash, equal neighbours, back by place.
    placed = F.array_sort(F.transform(f"{p}_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    one = one.withColumn(f"{p}_s", F.when(F.col(f"{p}_twice"), placed))
    h = F.transform(f"{p}_s", lambda x: x["h"])
    up = F.concat(F.slice(h, 2, F.greatest(F.size(f"{p}_s") - 1, F.lit(1))), F.array(F.lit(None).cast("long")))
    down = F.concat(F.array(F.lit(None).cast("long")), F.slice(h, 1, F.greatest(F.size(f"{p}_s") - 1, F.lit(1))))
    near = F.zip_with(up, down, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    mark = F.zip_with(f"{p}_s", near, lambda x, y: F.when(x["h"].eqNullSafe(y["a"]) | x["h"].eqNullSafe(y["b"]), x["i"]))
    one = one.withColumn(f"{p}_at", F.when(F.col(f"{p}_twice"), F.array_sort(F.filter(mark, lambda x: x.isNotNull()))))
    # The union of the windows [i, i + 8): each adds what lies before the next one.
    after = F.concat(F.slice(f"{p}_at", 2, F.greatest(F.size(f"{p}_at") - 1, F.lit(1))), F.array(F.lit(1 << 30)))
    covered = F.aggregate(F.zip_with(f"{p}_at", after, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)
    squeezed = F.translate(f"{p}_text", _SPACES, "")
    one = one.select(
        "*", F.col(f"{p}_n").cast("long").alias("q_n_words"), F.length(squeezed).cast("long").alias("q_word_chars"),
        (F.length(f"{p}_text") - F.length(F.translate(f"{p}_text", "#*$%&|<>", ""))).cast("long").alias("q_n_symbols"),
        (F.size(f"{p}_lines") - F.size(F.array_distinct(f"{p}_lines"))).cast("long").alias("q_n_dup_lines"),
        F.coalesce(F.when(F.col(f"{p}_twice"), covered), F.lit(0)).cast("long").alias("q_n_repeat_words"),
        F.length(F.regexp_replace(f"{p}_text", "[^A-Z]+", "")).alias(f"{p}_upper"), F.length(F.regexp_replace(f"{p}_text", "[^!]+", "")).alias(f"{p}_exclaim"),
        F.length(F.regexp_replace(f"{p}_text", "[^0-9]+", "")).alias(f"{p}_digit"), F.size(F.array_distinct(f"{p}_w")).alias(f"{p}_distinct"), F.size(f"{p}_lines").alias(f"{p}_n_lines"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    # The values leave as the row of a generator: the optimizer would put the whole expressions, with
    # the texts' arrays inside the lambdas, in place of columns in a filter that it moves down.
    values = [F.col(f"q_{c}") for c in BASE] + [
        share("q_word_chars", "q_n_words").alias("q_word_length"), share("q_n_symbols", "q_word_chars").alias("q_symbol_share"),
        share("q_n_dup_lines", f"{p}_n_lines").alias("q_dup_line_share"), share("q_n_repeat_words", "q_n_words").alias("q_repeat_share"), share(f"{p}_upper", "q_word_chars").alias("q_upper_share"),
        share(f"{p}_exclaim", "q_n_words").alias("q_exclaim_share"), share(f"{p}_digit", "q_word_chars").alias("q_digit_share"), share(f"{p}_distinct", "q_n_words").alias("q_word_variety"),
    ]
    return one.select(*docs.columns, F.inline(F.array(F.struct(*values))))


def base_failed(least_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("q_n_words") < least_words) | (100 * F.col("q_n_repeat_words") > repeat_percent * F.col("q_n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects where every condition (statistic, is_at_least, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, least, value in self.conditions:
            c = F.col(f"q_{name}")
            out = out & ((c >= value) if least else (c <= value))
        return out

    def covers(self, row: dict) -> bool:
        return all((row[n] >= v) if least else (row[n] <= v) for n, least, v in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def rejects(self) -> Column:
        """The ordered conditional expression."""
        if not self.rules:
            return F.lit(False)
        out = F.when(self.rules[0].column(), F.lit(True))
        for r in self.rules[1:]:
            out = out.when(r.column(), F.lit(True))
        return out.otherwise(F.lit(False))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    from math import log2

    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else float("-inf")


def _grow(rows: list[dict], names: list[str], most: int, cuts: int) -> Rule:
    """Adds, one at a time, the condition with the highest information gain."""
    rule: list[tuple[str, bool, float]] = []
    while len(rule) < most and any(not r["bad"] for r in rows):
        p0, n0 = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
        best, pick = 1e-9, None
        for name in names:
            ordered = sorted(rows, key=lambda r: r[name])
            values = [r[name] for r in ordered]
            bad = [0]
            for r in ordered:
                bad.append(bad[-1] + r["bad"])
            marks = sorted({max(1, len(rows) * i // cuts) for i in range(1, cuts)})
            for m in marks:
                if m >= len(values) or values[m - 1] == values[m]:
                    continue
                v = (values[m - 1] + values[m]) / 2
                for least, p, size in ((False, bad[m], m), (True, bad[-1] - bad[m], len(rows) - m)):
                    g = _gain(p, size - p, p0, n0)
                    if g > best:
                        best, pick = g, (name, least, v)
        if pick is None:
            break
        rule.append(pick)
        rows = [r for r in rows if Rule((pick,)).covers(r)]
    return Rule(tuple(rule))


def _worth(rule: Rule, rows: list[dict]) -> tuple[float, int, int]:
    p = sum(1 for r in rows if r["bad"] and rule.covers(r))
    n = sum(1 for r in rows if not r["bad"] and rule.covers(r))
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn(rows: list[dict], names: list[str] = STATISTICS, precision: float = 0.97, least_covered: int = 5, most_rules: int = 12, most_conditions: int = 4, cuts: int = 64) -> DecisionList:
    """Sequential covering over rows with the statistics and ``bad``. Odd rows prune, even ones grow."""
    grow, prune, rules = rows[0::2], rows[1::2], []
    while len(rules) < most_rules and any(r["bad"] for r in grow) and any(not r["bad"] for r in grow):
        rule = _grow(grow, names, most_conditions, cuts)
        while len(rule.conditions) > 1:  # prune: drop final conditions while that does not hurt
            shorter = Rule(rule.conditions[:-1])
            if _worth(shorter, prune)[0] < _worth(rule, prune)[0]:
                break
            rule = shorter
        _, p, n = _worth(rule, prune)
        _, gp, gn = _worth(rule, grow)
        if not rule.conditions or p + gp < least_covered or p < precision * (p + n) or gp < precision * (gp + gn) or p == 0:
            break
        rules.append(rule)
        grow, prune = [r for r in grow if not rule.covers(r)], [r for r in prune if not rule.covers(r)]
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 6000) -> DecisionList:
    """Learns from at most ``most_labels`` labelled documents, those with the least hashes."""
    picked = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(most_labels)
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = with_statistics(joined).where(~base_failed()).select("_id", "_quality", *[F.col(f"q_{n}").cast("double").alias(n) for n in STATISTICS])
    got = rows.limit(2 * most_labels).collect()  # bounded by the parameter
    got.sort(key=lambda r: (r["_id"] * 2654435761 % (1 << 32), r["_id"]))
    return learn([{n: r[n] for n in STATISTICS} | {"bad": r["_quality"] == 0} for r in got])


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds the statistics, ``base_failed`` and ``kept``."""
    out = with_statistics(docs.drop(*[c for c in docs.columns if c.lower() in ("base_failed", "kept")]))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rules.rejects())
