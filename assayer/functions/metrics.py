"""Deterministic metrics as columns over sample columns. A metric that cannot be computed is null."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import text as T
from .vector import average_precision


def string_presence(response: Column, reference: Column) -> Column:
    return F.contains(response, T.utrim(reference)).cast("double")


def _closest(x: Column, others: Column) -> Column:
    return F.array_max(F.transform(others, lambda r: T.levenshtein_similarity(x, r)))


def context_precision(retrieved: Column, reference: Column, at: float = 0.5) -> Column:
    hits = F.transform(retrieved, lambda c: F.when(_closest(c, reference) >= at, 1).otherwise(0))
    return F.when(F.size(reference) > 0, average_precision(hits))


def context_recall(retrieved: Column, reference: Column, at: float = 0.5) -> Column:
    hit = F.size(F.filter(reference, lambda r: _closest(r, retrieved) >= at))
    return F.when(F.size(reference) > 0, hit / F.size(reference))


def _ids(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, T.utrim), lambda x: x != ""))


def id_precision(retrieved: Column, reference: Column) -> Column:
    """Retrieved ids count with repeats and blanks."""
    hit = T.let(_ids(reference), lambda ref: F.size(F.filter(retrieved, lambda x: F.array_contains(ref, T.utrim(x)))))
    return F.when(F.size(retrieved) > 0, hit / F.size(retrieved)).otherwise(F.lit(0.0))


def id_recall(retrieved: Column, reference: Column) -> Column:
    """Of sets; undefined (null) without reference ids."""
    return F.when(F.size(_ids(reference)) > 0, F.size(F.array_intersect(_ids(reference), _ids(retrieved))) / F.size(_ids(reference)))


def table_overlap(a: Column, b: Column, mode: str = "f1") -> Column:
    """Rows of two tables, as arrays of row texts, compared as multisets."""
    hit = T.multiset_overlap(a, b)
    p = F.when(F.size(a) > 0, hit / F.size(a)).otherwise(F.lit(0.0))
    r = hit / F.size(b)
    value = {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}[mode]
    return F.when(F.size(b) > 0, value)


@F.pandas_udf(ArrayType(StringType()))
def csv_rows(c: pd.Series) -> pd.Series:
    """The records of headerless CSV texts, cells joined by a unit separator; blank lines are none."""
    return pd.Series([["\x1f".join(r) for r in csv.reader(io.StringIO(t or "", newline="")) if r] for t in c])


def lexical_context_recall(reference: Column, contexts: Column) -> Column:
    """Share of the reference's claims whose tokens the contexts have among them."""
    known = F.array_distinct(F.flatten(F.transform(contexts, T.meaningful_tokens)))
    cs = T.claims(reference)
    hit = T.let(known, lambda k: F.size(F.filter(cs, lambda c: T.let(T.meaningful_tokens(c), lambda t: T.supported(t, k)))))
    return F.when(F.size(cs) > 0, hit / F.size(cs)).otherwise(F.lit(0.0))


def lexical_entity_recall(reference: Column, contexts: Column) -> Column:
    known = F.flatten(F.transform(contexts, T.meaningful_tokens))
    es = T.lexical_entities(reference)
    return F.when(F.size(es) > 0, F.size(F.array_intersect(es, known)) / F.size(es)).otherwise(F.lit(0.0))


def lexical_context_relevance(question: Column, contexts: Column) -> Column:
    """Mean over contexts of the share of the question's tokens that each has."""
    q = F.array_distinct(T.meaningful_tokens(question))
    each = T.let(q, lambda t: F.transform(contexts, lambda c: F.size(F.array_intersect(t, T.meaningful_tokens(c))) / F.size(t)))
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(q) > 0) & (F.size(contexts) > 0), total / F.size(contexts)).otherwise(F.lit(0.0))


def lexical_groundedness(response: Column, contexts: Column) -> Column:
    """Share of the response's claims that a single context supports."""
    cs = T.claims(response)
    known = F.transform(contexts, T.meaningful_tokens)
    hit = T.let(known, lambda ks: F.size(F.filter(cs, lambda c: T.let(T.meaningful_tokens(c), lambda t: F.exists(ks, lambda k: T.supported(t, k))))))
    return F.when(F.size(cs) > 0, hit / F.size(cs)).otherwise(F.lit(0.0))


def tool_calls(messages: Column) -> Column:
    """Calls of assistant messages, in order."""
    return F.flatten(F.transform(F.filter(messages, lambda m: m["role"] == "Assistant"), lambda m: m["tool_calls"]))


def call_keys(calls: Column) -> Column:
    """Name and arguments as one text; arguments are canonical JSON already."""
    return F.transform(calls, lambda t: F.concat(t["name"], F.lit("\u0001"), t["arguments"]))


def tool_call_accuracy(actual: Column, expected: Column, ordered: bool = True) -> Column:
    """Of call keys: matches by place, or one to one in any order, over the longer side."""
    same = F.size(F.filter(F.zip_with(actual, expected, lambda a, b: a == b), lambda e: e.isNotNull() & e))
    hit = same if ordered else T.multiset_overlap(actual, expected)
    return F.when(F.size(expected) > 0, hit / F.greatest(F.size(actual), F.size(expected)))


def tool_call_f1(actual: Column, expected: Column) -> Column:
    hit = T.multiset_overlap(actual, expected)
    p = F.when(F.size(actual) > 0, hit / F.size(actual)).otherwise(F.lit(1.0))
    r = F.when(F.size(expected) > 0, hit / F.size(expected)).otherwise(F.lit(1.0))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def ratio(n: Column, d: Column, of_nothing: float = 0.0) -> Column:
    """A share; what a share of nothing is, differs between families of metrics."""
    return F.when(d == 0, F.lit(of_nothing)).otherwise(n / d)


def numeric_result(score: Column) -> Column:
    """(value, error) of a score that must lie in [0, 1]: one outside is an error of its row alone."""
    good = score.between(0, 1) & ~F.isnan(score)
    return F.struct(F.when(good, score).alias("value"), F.when(~good, F.lit("metric task failed: the score is not in [0, 1]")).alias("error"))


def aspect_critic(score: Column, threshold: float | None = None) -> Column:
    """A judge's score between 0 and 1, or with a threshold whether it is reached."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return c if threshold is None else (c >= threshold).cast("double")


def judge_score(output: Column, repair: bool = False) -> Column:
    """(score, reason, repaired, error) of a judge's JSON with a numeric score and perhaps a reason in
    text; with repair the part from the first to the last brace is read. An error quotes the first 80
    characters."""
    cut = F.regexp_extract(output, r"(?s)\{.*\}", 0) if repair else output
    cut = F.when(cut != "", cut).otherwise(output)
    j = F.try_parse_json(cut)
    score, reason = F.try_variant_get(j, "$.score", "double"), F.try_variant_get(j, "$.reason", "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(j, path, "variant"))
    number = F.startswith(kind("$.score"), F.lit("BIGINT")) | F.startswith(kind("$.score"), F.lit("DECIMAL")) | F.startswith(kind("$.score"), F.lit("DOUBLE"))
    said = kind("$.reason")
    wrong = F.when(j.isNull(), "judge output is no JSON").when(~F.coalesce(number, F.lit(False)), "judge output has no numeric score").when(said.isNotNull() & ~said.isin("STRING", "VOID"), "judge output has a reason that is no text")
    error = F.when(wrong.isNotNull(), F.concat(wrong, F.lit(": "), F.left(output, F.lit(80))))
    return F.struct(F.when(error.isNull(), score).alias("score"), F.when(error.isNull() & (said == "STRING"), reason).alias("reason"), (error.isNull() & (cut != output)).alias("repaired"), error.alias("error"))


def summarization_score(output: Column) -> Column:
    """(value, error): the mean of coverage and conciseness in a judge's JSON, each from 0 to 1."""
    g = F.from_json(output, "coverage double, conciseness double")
    inside = lambda c: F.coalesce(c.between(0, 1), F.lit(False))
    error = F.when(F.try_parse_json(output).isNull() | g["coverage"].isNull() | g["conciseness"].isNull(), "summarization judge output cannot be parsed")
    error = F.coalesce(error, F.when(~inside(g["coverage"]), "coverage must be in [0, 1]"), F.when(~inside(g["conciseness"]), "conciseness must be in [0, 1]"))
    return F.struct(F.when(error.isNull(), (g["coverage"] + g["conciseness"]) / 2).alias("value"), error.alias("error"))


# The image types that prompts may hold.
IMAGE_TYPES = ("image/png", "image/jpeg", "image/webp", "image/gif")


def prompt_scaffold(parts: Column) -> Column:
    """Lines for the parts (kind, text, mime) of a prompt; null where an image is of another type."""
    line = lambda p: F.when(p["kind"] == "text", F.concat(F.lit("[text] "), p["text"])).otherwise(F.concat(F.lit("[image "), p["mime"], F.lit("] "), p["text"]))
    good = F.forall(parts, lambda p: (p["kind"] == "text") | p["mime"].isin(*IMAGE_TYPES))
    return F.when(good, F.array_join(F.transform(parts, line), "\n"))


def multimodal_score(parts: Column, score: Column) -> Column:
    """(value, error) of a judged prompt with images."""
    bad = prompt_scaffold(parts).isNull()
    return F.struct(F.when(~bad, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).alias("value"), F.when(bad, F.lit("unsupported media type")).alias("error"))


def achieved_share(done: Column) -> Column:
    """Of an array of truth values the share that holds; 1 without any."""
    return ratio(F.size(F.filter(done, lambda x: x)), F.size(done), 1.0)


def sql_equivalence(response: Column, reference: Column, judged: Column | None = None) -> Column:
    """1 for equal normalised statements; a judge's verdict decides the others."""
    return F.when(T.normalize_sql(response) == T.normalize_sql(reference), F.lit(1.0)).otherwise(F.lit(0.0) if judged is None else judged)


def topic_adherence(answered: Column, in_scope: Column, mode: str = "f1") -> Column:
    """Of two arrays of truth values per topic; a missing classification is false."""
    pairs = F.zip_with(answered, in_scope, lambda a, s: F.struct(F.coalesce(a, F.lit(False)).alias("a"), F.coalesce(s, F.lit(False)).alias("s")))
    count = lambda f: F.size(F.filter(pairs, f))
    tp, fp, fn = count(lambda x: x["a"] & x["s"]), count(lambda x: x["a"] & ~x["s"]), count(lambda x: ~x["a"] & x["s"])
    eps = 1e-10
    p, r = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r + eps)}[mode]
