"""Lexical functions as native columns. Array results stay in the JVM; nothing here is a Python UDF
except the two edit distances and the LCS of long texts, for which Spark has no built-in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words without meaning for lexical support.
STOPWORDS = ["a", "an", "and", "are", "by", "does", "for", "how", "in", "is", "of", "the", "to", "with"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once: inside lambdas an expression would be computed anew
    for each element, a lambda's own variable is not."""
    return F.get(F.transform(F.array(value), body), 0)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def utrim(c: Column) -> Column:
    """Trims Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (utrim(c) == "")


def _bare(w: Column) -> Column:
    return F.regexp_replace(w, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")


def ws_tokens(c: Column) -> Column:
    """Tokens between Unicode white space, stripped to ASCII letters and digits at both ends."""
    cut = F.split(F.coalesce(c, F.lit("")), r"(?U)\s+")
    return F.filter(F.transform(cut, lambda w: ascii_lower(_bare(w))), lambda w: w != "")


def char_unigrams(c: Column) -> Column:
    """Characters without white space, A-Z lower-cased."""
    t = ascii_lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s", ""))
    return F.filter(F.split(t, ""), lambda x: x != "")


def ngrams(tokens: Column, n: int, glue: str = " ") -> Column:
    if n == 1:
        return tokens
    some = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), glue))
    return let(tokens, lambda t: F.when(F.size(t) >= n, some(t)).otherwise(F.array().cast("array<string>")))


def multiset_overlap(a: Column, b: Column) -> Column:
    """The sum over distinct values of the smaller count, in n log n."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def numbered(a: Column) -> Column:
    """Distinct markers: each value with the number of its occurrence. Values are sorted; where each
    run of equal ones ends tells how often it occurs."""
    ends = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1)))
    runs = lambda e: F.filter(F.zip_with(e, F.concat(F.array(F.lit(-1)), e), lambda x, p: F.struct(x.alias("x"), p.alias("p"))), lambda r: r["x"].isNotNull())
    marks = lambda s, r: F.transform(F.sequence(F.lit(1), r["x"] - r["p"]), lambda k: F.concat(F.get(s, r["x"]), F.lit("\u0001"), k.cast("string")))
    some = lambda s: let(ends(s), lambda e: F.flatten(F.transform(runs(e), lambda r: marks(s, r))))
    return let(F.sort_array(a), lambda s: F.when(F.size(s) > 0, some(s)).otherwise(F.array().cast("array<string>")))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two token arrays, row by row of the table."""
    zero = F.transform(b, lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        pairs = F.zip_with(b, F.arrays_zip(prev.alias("up"), F.concat(F.array(F.lit(0)), prev).alias("diag")), lambda y, p: F.struct(y.alias("y"), p["up"].alias("up"), p["diag"].alias("diag")))
        begin = F.struct(F.lit(0).alias("left"), F.array().cast("array<int>").alias("out"))

        def cell(s: Column, p: Column) -> Column:
            v = F.when(p["y"] == x, p["diag"] + 1).otherwise(F.greatest(p["up"], s["left"]))
            return F.struct(v.alias("left"), F.concat(s["out"], F.array(v)).alias("out"))

        return F.aggregate(F.filter(pairs, lambda p: p["y"].isNotNull()), begin, cell, lambda s: s["out"])

    return F.coalesce(F.array_max(F.aggregate(a, zero, row)), F.lit(0))


@F.pandas_udf(IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same for long texts, by bit vectors: one step per token of a."""

    def one(x, y) -> int:
        where: dict[str, int] = {}
        for i, w in enumerate(y):
            where[w] = where.get(w, 0) | (1 << i)
        full = (1 << len(y)) - 1
        v = full
        for w in x:
            u = v & where.get(w, 0)
            v = ((v + u) | (v - u)) & full
        return len(y) - v.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def exact_match(a: Column, b: Column) -> Column:
    return (utrim(a) == utrim(b)).cast("double")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def hamming_similarity(a: Column, b: Column) -> Column:
    """Padded to the longer side; a place that one side lacks differs."""
    cs = lambda x: F.filter(F.split(x, ""), lambda y: y != "")
    longest = F.greatest(F.char_length(a), F.char_length(b))
    same = F.size(F.filter(F.zip_with(cs(a), cs(b), lambda x, y: x == y), lambda e: e.isNotNull() & e))
    return F.when(longest == 0, F.lit(1.0)).otherwise(same / longest)


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    if j <= 0.7:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts as rows padded with zeros, and the texts' lengths."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), max(1, int(n.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, n


def jaro_many(a: list[str], b: list[str], winkler: bool = False, cells: int = 4_000_000) -> np.ndarray:
    """Jaro or Jaro-Winkler similarities of pairs, a character place of all pairs at a time."""
    wide = max(map(len, [*a, *b]), default=0)
    step = max(1, cells // max(1, wide))
    if len(a) > step:
        return np.concatenate([jaro_many(a[i : i + step], b[i : i + step], winkler, cells) for i in range(0, len(a), step)])
    (x, nx), (y, ny) = _points(a), _points(b)
    at = np.arange(y.shape[1])
    reach = np.maximum(np.maximum(nx, ny) // 2 - 1, 0)[:, None]
    free = at < ny[:, None]
    hit = np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        fits = free & (y == x[:, i : i + 1]) & (np.abs(at - i) <= reach) & (i < nx)[:, None]
        some = np.flatnonzero(fits.any(axis=1))
        free[some, fits[some].argmax(axis=1)] = False
        hit[some, i] = True
    taken = (at < ny[:, None]) & ~free
    m = hit.sum(axis=1)
    rows = np.repeat(np.arange(len(a)), m)
    swaps = np.bincount(rows[x[hit] != y[taken]], minlength=len(a)) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        j = np.where(m > 0, (m / nx + m / ny + (m - swaps) / m) / 3, np.where((nx == 0) & (ny == 0), 1.0, 0.0))
    if not winkler:
        return j
    k = min(4, x.shape[1], y.shape[1])
    inside = np.arange(k) < np.minimum(nx, ny)[:, None]
    same = np.minimum.accumulate((x[:, :k] == y[:, :k]) & inside, axis=1).sum(axis=1)
    return np.where(j > 0.7, j + same * 0.1 * (1 - j), j)


def _paired(a: pd.Series, b: pd.Series, winkler: bool) -> pd.Series:
    some = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), None, object)
    out[some] = jaro_many(a[some].tolist(), b[some].tolist(), winkler)
    return pd.Series(out, dtype="Float64").astype(object).where(some, None)


@F.pandas_udf(DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _paired(a, b, False)


@F.pandas_udf(DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _paired(a, b, True)


def string_similarity(a: Column, b: Column, measure: str = "levenshtein") -> Column:
    return {"levenshtein": levenshtein_similarity, "hamming": hamming_similarity, "jaro": jaro_similarity, "jaro_winkler": jaro_winkler_similarity}[measure](a, b)


def bleu_unigram(candidate: Column, reference: Column) -> Column:
    """Clipped precision of token arrays."""
    n, m = F.size(candidate), F.size(reference)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).otherwise(_ratio(multiset_overlap(candidate, reference), n))


def bleu(candidate: Column, reference: Column, most: int = 4) -> Column:
    """Geometric mean of clipped n-gram precisions with brevity penalty."""
    hits = F.array(*[multiset_overlap(ngrams(candidate, n), ngrams(reference, n)) for n in range(1, most + 1)])
    return let(F.struct(hits.alias("h"), F.size(candidate).alias("c"), F.size(reference).alias("r")), lambda s: _bleu(s["h"], s["c"], s["r"], most))


def _bleu(hits: Column, c: Column, r: Column, most: int) -> Column:
    logs = F.log(F.get(hits, 0) / c)
    for n in range(1, most):
        logs = logs + F.log(F.get(hits, n) / (c - n))
    penalty = F.when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / c))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), penalty * F.exp(logs / most)))
    return F.when((c == 0) & (r == 0), F.lit(1.0)).when((c < most) | (r == 0) | F.exists(hits, lambda h: h == 0), F.lit(0.0)).otherwise(score)


def rouge(candidate: Column, reference: Column, kind: str = "l", mode: str = "f", lcs=lcs_udf) -> Column:
    """ROUGE-1, -2 or -L of token arrays: precision (p), recall (r) or F1 (f); empty sides give 0."""
    if kind == "l":
        counts = F.struct(lcs(candidate, reference).alias("hit"), F.size(candidate).alias("c"), F.size(reference).alias("r"))
    else:
        n = int(kind)
        length = lambda x: F.greatest(F.size(x) - (n - 1), F.lit(0))
        counts = F.struct(multiset_overlap(ngrams(candidate, n), ngrams(reference, n)).alias("hit"), length(candidate).alias("c"), length(reference).alias("r"))
    f1 = lambda s: F.when(s["hit"] > 0, 2 * s["hit"] / (s["c"] + s["r"])).otherwise(F.lit(0.0))
    return let(counts, {"p": lambda s: _ratio(s["hit"], s["c"]), "r": lambda s: _ratio(s["hit"], s["r"]), "f": f1}[mode])


def rouge_l_recall(candidate: Column, reference: Column, lcs=lcs_udf) -> Column:
    """As the command line reports it: two empty sides agree."""
    n, m = F.size(candidate), F.size(reference)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).otherwise(_ratio(lcs(candidate, reference), m))


def chrf_unigram(a: Column, b: Column) -> Column:
    def f1(x: Column, y: Column) -> Column:
        n, m = F.size(x), F.size(y)
        return F.when((n == 0) & (m == 0), F.lit(1.0)).otherwise(_ratio(2 * multiset_overlap(x, y), n + m))

    return let(F.struct(char_unigrams(a).alias("x"), char_unigrams(b).alias("y")), lambda s: f1(s["x"], s["y"]))


def chrf(a: Column, b: Column, orders: int = 6, beta: float = 2.0) -> Column:
    """F-beta of precision and recall, averaged over the orders of which both sides have n-grams."""
    return let(F.struct(char_unigrams(a).alias("x"), char_unigrams(b).alias("y")), lambda s: _chrf(s["x"], s["y"], orders, beta))


def _chrf(x: Column, y: Column, orders: int, beta: float) -> Column:
    hits = F.array(*[multiset_overlap(ngrams(x, n, ""), ngrams(y, n, "")) for n in range(1, orders + 1)])
    count = F.least(F.size(x), F.size(y), F.lit(orders))

    def mean(h: Column, side: Column) -> Column:
        terms = [F.when(count >= n, F.get(h, n - 1) / (F.size(side) - (n - 1))).otherwise(F.lit(0.0)) for n in range(1, orders + 1)]
        return sum(terms[1:], terms[0]) / count

    f = lambda s: F.when(s["p"] + s["r"] > 0, (1 + beta * beta) * s["p"] * s["r"] / (beta * beta * s["p"] + s["r"])).otherwise(F.lit(0.0))
    score = let(hits, lambda h: let(F.struct(mean(h, x).alias("p"), mean(h, y).alias("r")), f))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when(count == 0, F.lit(0.0)).otherwise(score)


def quoted_texts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit('"([^"]*)"'), 1)


def quoted_spans(c: Column) -> Column:
    """Text between successive quotes with the offsets of characters and bytes; a single opener at
    the end has no span."""
    parts = F.split(c, '"')
    inside = F.filter(F.sequence(F.lit(1), F.size(parts) - 2), lambda i: i % 2 == 1)

    def span(i: Column) -> Column:
        before = F.concat(F.array_join(F.slice(parts, 1, i), '"'), F.lit('"'))
        t = F.get(parts, i)
        a, b = F.char_length(before), F.octet_length(before)
        return F.struct(t.alias("text"), a.alias("char_start"), (a + F.char_length(t)).alias("char_end"), b.alias("byte_start"), (b + F.octet_length(t)).alias("byte_end"))

    return F.when(F.size(parts) >= 3, F.transform(inside, span))


def span_iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Overlap of [a, b) and [c, d) over their hull."""
    hull = F.greatest(b, d) - F.least(a, c)
    return F.when(hull > 0, F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c)) / hull).otherwise(F.lit(0.0))


def citation_coverage(text: Column, sources: Column) -> Column:
    """Share of quoted texts that some source contains."""
    q = quoted_texts(text)
    hit = F.size(F.filter(q, lambda s: F.exists(sources, lambda x: F.contains(x, s))))
    return F.when((F.size(q) > 0) & (F.size(sources) > 0), hit / F.size(q)).otherwise(F.lit(0.0))


def normalize_sql(c: Column) -> Column:
    """For the metric: lower case, single spaces, no final semicolon."""
    t = utrim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    return utrim(F.regexp_replace(t, r";+$", ""))


def squeeze_sql(c: Column) -> Column:
    """For the helper: no white space and no semicolons at all."""
    return F.lower(F.regexp_replace(c, r"[ \t\n\r\f;]", ""))


def sentences(c: Column) -> Column:
    """Cut after each of . ! ? and kept with it; what follows the last is kept too."""
    cut = F.regexp_extract_all(c, F.lit(r"[^.!?]*[.!?]|[^.!?]+$"), 0)
    return F.filter(F.transform(cut, utrim), lambda s: s != "")


def claims(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[.?!;]"), utrim), lambda s: s != "")


def normal_token(w: Column) -> Column:
    t = ascii_lower(_bare(w))
    return F.when((F.octet_length(t) > 3) & F.endswith(t, F.lit("s")) & (t != "does"), F.substring(t, F.lit(1), F.char_length(t) - 1)).otherwise(t)


def meaningful_tokens(c: Column) -> Column:
    cut = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), normal_token)
    return F.filter(cut, lambda w: (F.octet_length(w) > 1) & ~w.isin(STOPWORDS))


def lexical_entities(c: Column) -> Column:
    """Normalised tokens that start with A-Z, each once."""
    cut = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), _bare)
    return F.array_distinct(F.filter(F.transform(F.filter(cut, lambda w: w.rlike("^[A-Z]")), normal_token), lambda w: w != ""))


def supported(claim_tokens: Column, context_tokens: Column) -> Column:
    return (F.size(claim_tokens) > 0) & (F.size(F.array_except(claim_tokens, context_tokens)) == 0)


def headings(c: Column) -> Column:
    """Texts of Markdown headings of one to six signs at the start of a line."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^#{1,6}[^\S\n]+(\S[^\n]*)$"), 1), utrim)


def overlap_themes(items: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(items, lambda s: F.split(s, " => "))))


def text_list(items: Column) -> Column:
    """Trimmed, without blanks, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, utrim), lambda x: x != "")))


def token_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def transcript(messages: Column) -> Column:
    """Lines of a conversation: what the human and the AI say, the AI's tool calls one to a line below
    their heading, and tool output. System messages and empty answers have no line."""
    empty = F.array().cast("array<string>")

    def lines(m: Column) -> Column:
        calls = F.transform(m["tool_calls"], lambda t: F.concat(F.lit("  "), t["name"], F.lit(": "), t["arguments"]))
        tools = F.when(F.size(m["tool_calls"]) > 0, F.concat(F.array(F.lit("Tools:")), calls)).otherwise(empty)
        answer = F.when(m["content"] != "", F.array(F.concat(F.lit("AI: "), m["content"]))).otherwise(empty)
        return (
            F.when(m["role"] == "User", F.array(F.concat(F.lit("Human: "), m["content"])))
            .when(m["role"] == "Tool", F.array(F.concat(F.lit("ToolOutput: "), m["content"])))
            .when(m["role"] == "Assistant", F.concat(answer, tools)).otherwise(empty)
        )

    return F.array_join(F.flatten(F.transform(messages, lines)), "\n")


def binary_verdict(c: Column) -> Column:
    """1, 0 or null from what a judge said: a number, a truth value, yes or no."""
    t = F.lower(utrim(c))
    number = F.when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), (t.cast("double") != 0).cast("double"))
    return F.when(t.isin("true", "yes"), F.lit(1.0)).when(t.isin("false", "no"), F.lit(0.0)).otherwise(number)


def mask_secret(c: Column) -> Column:
    """The first six and the last four characters."""
    return F.when(F.char_length(c) <= 10, F.lit("***")).otherwise(F.concat(F.left(c, F.lit(6)), F.lit("..."), F.right(c, F.lit(4))))


def redact_map(m: Column) -> Column:
    """Masks values under secret-looking keys and secret-looking values."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike("authorization|api[_-]?key|token|secret|password") | v.rlike("^(sk-|Bearer )"), F.lit("[REDACTED]")).otherwise(v))
