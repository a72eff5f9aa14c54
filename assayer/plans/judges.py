"""Model-judged metrics as staged DataFrames.

Every metric asks with a prompt that ends in a JSON request, reads the fields of the first object or
array of the answer with from_json, and reduces them by expressions. Rows that need no call never reach a stage: they are
filtered out before it and joined back after, so no branch of a conditional can trigger a call.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assayer.functions import text as T
from assayer.functions.metrics import sql_equivalence, topic_adherence
from assayer.functions.vector import average_precision, clamp, cosine, f1
from assayer.plans.providers import call_stage, json_block

Keep = Callable[[DataFrame], DataFrame]
UNDEFINED = float("nan")


@F.pandas_udf(StringType())
def _block(answers: pd.Series) -> pd.Series:
    return answers.map(lambda a: None if a is None else json_block(a))


def _parsed(answer: Column, schema: str) -> Column:
    """The JSON of an answer as schema, or null where it is no JSON of an object or array."""
    return F.when(F.try_parse_json(_block(answer)).isNotNull(), F.from_json(_block(answer), schema))


def ask(df: DataFrame, provider, keep: Keep, prompt: Column, when: Column, schema: str) -> DataFrame:
    """df with ``got`` (parsed) and ``failed`` (an error's text) for the rows where ``when`` holds. An
    answer that cannot be parsed is given back once to be put right; what comes back may be the right
    JSON or an object with it as ``text``."""
    asked = df.withColumn("_p", F.when(when, prompt))
    answers = call_stage(asked.select(F.col("_p").alias("request")), provider, keep)
    parsed = answers.select(F.col("request").alias("_p"), _parsed(F.col("answer"), schema).alias("got"), F.col("error").alias("failed"), "answer")
    broken = parsed.where("got is null and failed is null").select("_p", F.concat(F.lit("repair this output so that it meets the prompt, as JSON with the key text.\nprompt: "), "_p", F.lit("\noutput: "), F.coalesce("answer", F.lit(""))).alias("request"))
    if not broken.isEmpty():
        again = call_stage(broken, provider, keep)
        inner = F.get_json_object(_block(F.col("answer")), "$.text")
        again = broken.join(again, "request", "left").select("_p", F.coalesce(F.when(inner.isNotNull(), _parsed(inner, schema)), F.when(inner.isNull(), _parsed(F.col("answer"), schema))).alias("again"), F.col("error").alias("second"))
        parsed = parsed.join(again, "_p", "left").select("_p", F.coalesce("got", "again").alias("got"), F.coalesce("failed", "second").alias("failed"))
    parsed = parsed.select("_p", "got", F.coalesce("failed", F.when(F.col("got").isNull(), F.lit("parse error"))).alias("failed"))
    return asked.join(parsed, "_p", "left").drop("_p")


def _done(df: DataFrame, value: Column, needs: Column | None = None, message: str = "") -> DataFrame:
    error = F.coalesce(F.when(~needs, F.lit(message)) if needs is not None else F.lit(None).cast("string"), F.col("failed"))
    return df.select("sample_index", F.when(error.isNull(), value).alias("value"), error.alias("error"))


def _ones(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x["verdict"] == 1))


def _contexts() -> Column:
    return F.array_join("retrieved_contexts", "\n")


def faithfulness(df: DataFrame, provider, keep: Keep) -> DataFrame:
    """Supported statements of the answer over all of them; undefined without statements."""
    a = ask(df, provider, keep, F.concat(F.lit("statements of: "), "response"), F.lit(True), "statements array<string>")
    a = keep(a.select("sample_index", _contexts().alias("ctx"), F.col("got.statements").alias("s"), F.col("failed").alias("f0")))
    b = ask(a, provider, keep, F.concat(F.lit("verdicts for: "), F.to_json("s"), F.lit("\ncontext: "), "ctx"), F.size("s") > 0, "verdicts array<struct<verdict:int>>")
    v = F.col("got.verdicts")
    b = b.withColumn("failed", F.coalesce("f0", "failed", F.when(F.size(v) != F.size("s"), F.lit("parse error: as many verdicts as statements are needed"))))
    return _done(b, F.when(F.size("s") == 0, F.lit(UNDEFINED)).otherwise(_ones(v) / F.size(v)))


def context_verdicts(df: DataFrame, provider, keep: Keep, against: str = "reference") -> DataFrame:
    """Average precision of per-context verdicts; no contexts give 0."""
    one = df.select("sample_index", "user_input", F.col(against).alias("target"), F.posexplode("retrieved_contexts").alias("k", "ctx"))
    a = ask(one, provider, keep, F.concat(F.lit("useful? question: "), "user_input", F.lit("\nanswer: "), "target", F.lit("\ncontext: "), "ctx"), ~T.is_blank(F.col("target")), "verdict int")
    g = a.groupBy("sample_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("got.verdict", F.lit(0)).alias("v")))), lambda x: x["v"]).alias("v"), F.max("failed").alias("failed"))
    return _done(df.select("sample_index", F.col(against).alias("t")).join(g, "sample_index", "left"), F.when(F.col("v").isNull(), F.lit(0.0)).otherwise(average_precision(F.col("v"))), ~T.is_blank(F.col("t")), f"{against} is required")


def context_recall(df: DataFrame, provider, keep: Keep) -> DataFrame:
    """Sentences of the reference attributed to the contexts over all of them."""
    s = T.sentences(F.col("reference"))
    a = df.withColumn("s", s)
    a = ask(a, provider, keep, F.concat(F.lit("attribute: "), F.to_json("s"), F.lit("\ncontext: "), _contexts()), F.size("s") > 0, "classifications array<struct<verdict:int>>")
    v = F.col("got.classifications")
    a = a.withColumn("failed", F.coalesce("failed", F.when(F.size(v) != F.size("s"), F.lit("parse error: as many verdicts as sentences are needed"))))
    return _done(a, _ones(v) / F.size("s"), ~T.is_blank(F.col("reference")), "reference is required")


def entity_recall(df: DataFrame, provider, keep: Keep) -> DataFrame:
    """Lower-cased entities of the reference found among those of the contexts."""
    a = ask(df, provider, keep, F.concat(F.lit("entities of: "), "reference"), ~T.is_blank(F.col("reference")), "entities array<string>")
    low = lambda c: F.array_distinct(F.transform(c, F.lower))
    a = keep(a.select("sample_index", "reference", _contexts().alias("ctx"), low(F.col("got.entities")).alias("e"), F.col("failed").alias("f0")))
    b = ask(a, provider, keep, F.concat(F.lit("entities of: "), "ctx"), F.size("e") > 0, "entities array<string>")
    b = b.withColumn("failed", F.coalesce("f0", "failed"))
    return _done(b, F.when(F.size("e") == 0, F.lit(UNDEFINED)).otherwise(F.size(F.array_intersect("e", low(F.col("got.entities")))) / F.size("e")), ~T.is_blank(F.col("reference")), "reference is required")


def ratings(df: DataFrame, provider, keep: Keep, first: Column, second: Column, when: Column) -> DataFrame:
    """Mean of two ratings from 0 to 4, over 4; rows where ``when`` fails score 0."""
    a = ask(df, provider, keep, F.concat(F.lit("rate: "), first), when, "rating int")
    a = keep(a.withColumn("r1", F.col("got.rating")).withColumnRenamed("failed", "f0").drop("got"))
    b = ask(a, provider, keep, F.concat(F.lit("rate again: "), second), when, "rating int")
    b = b.withColumn("failed", F.coalesce("f0", "failed"))
    cut = lambda c: F.least(F.lit(4), F.greatest(F.lit(0), c))
    return _done(b, F.when(~when, F.lit(0.0)).otherwise((cut(F.col("r1")) + cut(F.col("got.rating"))) / 8))


def context_relevance(df: DataFrame, provider, keep: Keep) -> DataFrame:
    p = F.concat(F.lit("relevance of "), _contexts(), F.lit(" to "), "user_input")
    return ratings(df, provider, keep, p, p, F.size("retrieved_contexts") > 0)


def response_groundedness(df: DataFrame, provider, keep: Keep) -> DataFrame:
    p = F.concat(F.lit("groundedness of "), "response", F.lit(" in "), _contexts())
    return ratings(df, provider, keep, p, p, F.size("retrieved_contexts") > 0)


def answer_accuracy(df: DataFrame, provider, keep: Keep) -> DataFrame:
    one, two = F.concat(F.lit("accuracy of "), "response", F.lit(" by "), "reference"), F.concat(F.lit("accuracy of "), "reference", F.lit(" by "), "response")
    return ratings(df, provider, keep, one, two, F.lit(True))


def factual_correctness(df: DataFrame, provider, keep: Keep) -> DataFrame:
    a = ask(df, provider, keep, F.concat(F.lit("claims of "), "response", F.lit(" by "), "reference"), ~T.is_blank(F.col("reference")), "TP array<string>, FP array<string>, FN array<string>")
    n = lambda k: F.coalesce(F.size(F.col(f"got.{k}")), F.lit(0))
    return _done(a, f1(n("TP"), n("FP"), n("FN")), ~T.is_blank(F.col("reference")), "reference is required")


def answer_correctness(df: DataFrame, provider, embedder, keep: Keep, factual: float = 0.75, semantic: float = 0.25) -> DataFrame:
    fact = factual_correctness(df, provider, keep).withColumnRenamed("value", "f").withColumnRenamed("error", "e1")
    sim = semantic_similarity(df, embedder, keep).withColumnRenamed("value", "s").withColumnRenamed("error", "e2")
    both = fact.join(sim, "sample_index").withColumn("failed", F.coalesce("e1", "e2"))
    return _done(both, (F.col("f") * factual + F.col("s") * semantic) / (factual + semantic))


def semantic_similarity(df: DataFrame, embedder, keep: Keep, at: float = 0.0) -> DataFrame:
    """Clamped cosine of answer and reference; a positive threshold makes it 0 or 1."""
    text = lambda c: F.when(F.col(c) == "", F.lit(" ")).otherwise(F.col(c))
    d = df.select("sample_index", "reference", text("response").alias("a"), text("reference").alias("b"))
    v = call_stage(d.select(F.explode(F.array("a", "b")).alias("request")), embedder, keep)
    x, y = (v.select(F.col("request").alias(k), F.col("vector").alias(f"v{k}"), F.col("error").alias(f"e{k}")) for k in "ab")
    j = d.join(x, "a", "left").join(y, "b", "left").withColumn("failed", F.coalesce("ea", "eb"))
    score = clamp(cosine(F.col("va"), F.col("vb")))
    return _done(j, (score >= at).cast("double") if at > 0 else score, F.col("reference").isNotNull(), "reference is required")


def response_relevancy(df: DataFrame, provider, embedder, keep: Keep, strictness: int = 3) -> DataFrame:
    """Mean cosine of the question and those that the answer suggests; 0 if the answer evades."""
    a = ask(df, provider, keep, F.concat(F.lit(f"{strictness} questions answered by: "), "response"), F.lit(True), "questions array<struct<question:string,noncommittal:int>>")
    a = keep(a.select("sample_index", "user_input", F.col("got.questions").alias("q"), "failed"))
    evades = F.exists("q", lambda x: x["noncommittal"] == 1)
    one = a.where(~evades).select("sample_index", "user_input", F.explode("q").alias("x")).select("sample_index", "user_input", F.col("x.question").alias("question"))
    v = call_stage(one.select(F.explode(F.array("user_input", "question")).alias("request")), embedder, keep).select("request", "vector")
    x, y = v.select(F.col("request").alias("user_input"), F.col("vector").alias("u")), v.select(F.col("request").alias("question"), F.col("vector").alias("w"))
    mean = one.join(x, "user_input").join(y, "question").groupBy("sample_index").agg(F.avg(cosine(F.col("u"), F.col("w"))).alias("m"))
    return _done(a.join(mean, "sample_index", "left"), F.when(F.size("q") == 0, F.lit(UNDEFINED)).when(evades, F.lit(0.0)).otherwise(F.col("m")))


def aspect_critic(df: DataFrame, provider, keep: Keep, definition: str, strictness: int = 1) -> DataFrame:
    """Strict majority of binary verdicts; each round asks in words of its own."""
    n, err = F.lit(0), F.lit(None).cast("string")
    for k in range(strictness):
        df = ask(df, provider, keep, F.concat(F.lit(f"criterion ({k}): {definition}\nanswer: "), "response"), F.lit(True), "verdict int")
        df = keep(df.withColumn(f"v{k}", F.col("got.verdict")).withColumnRenamed("failed", f"f{k}").drop("got"))
        n, err = n + F.when(F.col(f"v{k}") == 1, 1).otherwise(0), F.coalesce(err, F.col(f"f{k}"))
    return _done(df.withColumn("failed", err), (n * 2 > strictness).cast("double"))


def rubric_score(df: DataFrame, provider, keep: Keep, rubric: str | None = None) -> DataFrame:
    """The judge's raw score by one rubric, or by the sample's own."""
    text = F.lit(rubric) if rubric is not None else F.to_json("rubrics")
    needs = F.lit(True) if rubric is not None else F.coalesce(F.size("rubrics") > 0, F.lit(False))
    a = ask(df, provider, keep, F.concat(F.lit("score by "), text, F.lit(": "), "response"), needs, "score double, feedback string")
    return _done(a, F.col("got.score"), needs, "rubrics are required")


def sql_semantic_equivalence(df: DataFrame, provider, keep: Keep) -> DataFrame:
    """Equal statements need no judge."""
    same = T.normalize_sql(F.col("response")) == T.normalize_sql(F.col("reference"))
    a = ask(df, provider, keep, F.concat(F.lit("same result? "), "response", F.lit(" / "), "reference", F.lit("\nschema: "), _contexts()), ~same, "verdict int")
    return _done(a, sql_equivalence(F.col("response"), F.col("reference"), (F.col("got.verdict") == 1).cast("double")))


def summarization_score(df: DataFrame, provider, keep: Keep) -> DataFrame:
    """Questions on the contexts that the answer covers, over the questions."""
    a = ask(df, provider, keep, F.concat(F.lit("yes/no questions on: "), _contexts()), F.size("retrieved_contexts") > 0, "questions array<string>")
    a = keep(a.select("sample_index", "response", "retrieved_contexts", F.col("got.questions").alias("q"), F.col("failed").alias("f0")))
    b = ask(a, provider, keep, F.concat(F.lit("answer from "), "response", F.lit(": "), F.to_json("q")), F.size("q") > 0, "answers array<struct<verdict:int>>")
    b = b.withColumn("failed", F.coalesce("f0", "failed"))
    return _done(b, F.when(F.size("q") == 0, F.lit(UNDEFINED)).otherwise(_ones(F.col("got.answers")) / F.size("q")), F.size("retrieved_contexts") > 0, "contexts are required")


def goal_accuracy(df: DataFrame, provider, keep: Keep, with_reference: bool = True) -> DataFrame:
    """Whether the end state of a conversation reaches the reference, or the goal inferred from it."""
    a = ask(df.withColumn("t", T.transcript(F.col("messages"))), provider, keep, F.concat(F.lit("goal and end state: "), "t"), F.lit(True), "user_goal string, end_state string")
    target = F.col("reference") if with_reference else F.col("got.user_goal")
    a = keep(a.select("sample_index", target.alias("goal"), F.col("got.end_state").alias("end"), F.col("failed").alias("f0")))
    b = ask(a, provider, keep, F.concat(F.lit("reached? "), "goal", F.lit(" / "), "end"), F.col("goal").isNotNull() & F.col("f0").isNull(), "verdict string")
    return _done(b.withColumn("failed", F.coalesce("f0", "failed")), T.binary_verdict(F.col("got.verdict")), F.col("goal").isNotNull() | F.col("f0").isNotNull(), "reference is required")


def noise_sensitivity(df: DataFrame, provider, keep: Keep, relevant: bool = True) -> DataFrame:
    """Statements that the reference does not bear out but contexts of the target kind do, over all of
    them. Contexts are of the relevant kind if the reference follows from them. No contexts, or none
    of the kind, give 0; no statements leave it undefined."""
    verdicts = "verdicts array<struct<verdict:int>>"
    got = F.transform("got.verdicts", lambda x: x["verdict"])
    short = lambda of: F.when(F.size("got.verdicts") != F.size(of), F.lit(f"parse error: one verdict per entry of {of} is needed"))
    judged = lambda against: F.concat(F.lit("verdicts for: "), F.to_json("statements"), F.lit("\ncontext: "), against)
    start = df.select("sample_index", "response", "reference", "retrieved_contexts").withColumn("wanted", ~T.is_blank(F.col("reference")) & (F.size("retrieved_contexts") > 0))
    a = ask(start, provider, keep, F.concat(F.lit("statements of: "), "response"), F.col("wanted"), "statements array<string>")
    a = keep(a.select(*start.columns, F.col("got.statements").alias("statements"), F.col("failed").alias("bad")))
    b = ask(a, provider, keep, judged(F.col("reference")), F.size("statements") > 0, verdicts)
    b = keep(b.withColumn("right", got).withColumn("bad", F.coalesce("bad", "failed", short("statements"))).drop("got", "failed"))
    c = ask(b, provider, keep, F.concat(F.lit("attribute: "), "reference", F.lit("\ncontexts: "), F.to_json("retrieved_contexts")), (F.size("statements") > 0) & F.col("bad").isNull(), verdicts)
    c = c.withColumn("kinds", got).withColumn("bad", F.coalesce("bad", "failed", short("retrieved_contexts"))).drop("got", "failed")
    c = keep(c.withColumn("target", F.filter("retrieved_contexts", lambda x, i: F.coalesce(F.get("kinds", i) == 1, F.lit(False)) == relevant)))
    d = ask(c, provider, keep, judged(F.array_join("target", "\n")), (F.size("statements") > 0) & (F.size("target") > 0) & F.col("bad").isNull(), verdicts)
    d = d.withColumn("failed", F.coalesce("bad", "failed", short("statements")))
    noisy = F.size(F.filter(F.zip_with("right", got, lambda r, g: (r == 0) & (g == 1)), lambda x: x))
    value = F.when(F.size("retrieved_contexts") == 0, 0.0).when(F.size("statements") == 0, UNDEFINED).when(F.size("target") == 0, 0.0).otherwise(noisy / F.size("statements"))
    return _done(d, value, ~T.is_blank(F.col("reference")), "reference is required")


def topic_adherence_score(df: DataFrame, provider, keep: Keep, mode: str = "f1") -> DataFrame:
    """Topics of the user's turns: those answered against those within reference_topics. One call finds
    the topics, one classifies them, and each topic is asked for once; no topics give 0."""
    yes = lambda c: F.coalesce(F.lower(F.trim(c)).isin("true", "1", "1.0", "yes"), F.lit(False))
    needs = F.coalesce(F.size("reference_topics") > 0, F.lit(False))
    a = df.select("sample_index", "reference_topics", T.transcript(F.col("messages")).alias("talk"))
    a = ask(a, provider, keep, F.concat(F.lit("topics of: "), "talk"), needs, "topics array<string>")
    a = keep(a.select("sample_index", "reference_topics", "talk", F.col("got.topics").alias("topics"), F.col("failed").alias("bad")))
    one = a.select("sample_index", "talk", F.posexplode("topics").alias("k", "topic"))
    b = ask(one, provider, keep, F.concat(F.lit("refused? "), "topic", F.lit("\nconversation: "), "talk"), F.lit(True), "refused_to_answer string")
    told = F.struct("k", (~yes(F.col("got.refused_to_answer"))).alias("answered"))
    b = b.groupBy("sample_index").agg(F.transform(F.sort_array(F.collect_list(told)), lambda x: x["answered"]).alias("answered"), F.max("failed").alias("bad2"))
    c = ask(a, provider, keep, F.concat(F.lit("within "), F.to_json("reference_topics"), F.lit("? "), F.to_json("topics")), F.size("topics") > 0, "classifications array<string>")
    c = c.join(b, "sample_index", "left").withColumn("failed", F.coalesce("bad", "bad2", "failed"))
    scope = F.slice(F.transform("got.classifications", yes), F.lit(1), F.size("topics"))
    return _done(c, F.when(F.size("topics") == 0, 0.0).otherwise(topic_adherence(F.col("answered"), scope, mode)), needs, "reference_topics are required")
