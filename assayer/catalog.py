"""The registered queries over the driver's tables, with their oracles.

Scores are rounded to six digits on both sides. A query without an oracle is one that SQL cannot
express; tests hold it against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import metrics as M
from assayer.functions import text as T
from assayer.functions import vector as V
from assayer.operators import aggregates as A
from assayer.operators import graph as G
from assayer.operators.chunking import chunk_documents
from assayer.plans import judges
from assayer.plans.evaluate import evaluate
from assayer.plans.providers import HashEmbedding, Scripted, rule_judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the assistant's next one, and a benchmark passage as reference."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("answer"))
    b = table(spark, d, "benchmark")
    n = b.count()
    b = F.broadcast(b.select("item_id", F.col("text").alias("reference"))) if n <= 10_000 else b.select("item_id", F.col("text").alias("reference"))
    return c.where("role = 'user' and r2 = 'assistant'").join(b, F.pmod("conv_id", F.lit(n)) == b["item_id"]).select("conv_id", "turn", "question", "answer", "reference")


def tokens_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '\\s+'), lambda w: translate(regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), '{T.UPPER}', '{T.LOWER}')), lambda w: w <> '')"


def meaning_sql(x: str) -> str:
    bare = f"list_transform(string_split_regex({x}, '\\s+'), lambda w: translate(regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), '{T.UPPER}', '{T.LOWER}'))"
    cut = f"list_transform({bare}, lambda w: CASE WHEN strlen(w) > 3 AND w LIKE '%s' AND w <> 'does' THEN w[:-2] ELSE w END)"
    return f"list_filter({cut}, lambda w: strlen(w) > 1 AND w NOT IN ({', '.join(repr(s) for s in T.STOPWORDS)}))"


PAIRS = """c AS (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS r2, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, question, answer, b.text AS reference FROM c JOIN benchmark b ON b.item_id = c.conv_id % (SELECT count(*) FROM benchmark) WHERE role = 'user' AND r2 = 'assistant')"""
TOKENS = f"WITH {PAIRS}, t AS (SELECT conv_id, turn, answer, reference, {tokens_sql('answer')} AS a, {tokens_sql('reference')} AS b FROM pairs)"


def grams_sql(source: str, n: int, glue: str = " ") -> str:
    part = f" || '{glue}' || ".join(f"{source}[i + {k}]" if k else f"{source}[i]" for k in range(n))
    return f"(SELECT conv_id, turn, {part} AS g FROM (SELECT conv_id, turn, {source}, unnest(range(1, len({source}) - {n} + 2)) AS i FROM t))"


def hits_sql(n: int, glue: str = " ") -> str:
    """Rows (conv_id, turn, hits): clipped n-gram overlap of a and b of t."""
    one = lambda s: f"(SELECT conv_id, turn, g, count(*) AS k FROM {grams_sql(s, n, glue)} GROUP BY ALL)"
    return f"(SELECT x.conv_id, x.turn, sum(least(x.k, y.k)) AS hits FROM {one('a')} x JOIN {one('b')} y USING (conv_id, turn, g) GROUP BY ALL)"


def _tokens(spark, d):
    return pairs(spark, d).select("conv_id", "turn", "answer", "reference", T.ws_tokens(F.col("answer")).alias("a"), T.ws_tokens(F.col("reference")).alias("b"))


@query(f"{TOKENS} SELECT conv_id, turn, round(coalesce(hits, 0) / len(b), 6) AS score FROM t LEFT JOIN {hits_sql(1)} USING (conv_id, turn)")
def rouge1_recall_pairs(spark, d):
    return _tokens(spark, d).select("conv_id", "turn", r6(T.rouge(F.col("a"), F.col("b"), "1", "r")).alias("score"))


@query(f"""{TOKENS}, h AS (SELECT conv_id, turn, coalesce(hits, 0) AS h, greatest(len(a) - 1, 0) AS n, greatest(len(b) - 1, 0) AS m FROM t LEFT JOIN {hits_sql(2)} USING (conv_id, turn))
SELECT conv_id, turn, round(CASE WHEN h = 0 THEN 0.0 ELSE 2 * (h / n) * (h / m) / (h / n + h / m) END, 6) AS score FROM h""")
def rouge2_f_pairs(spark, d):
    return _tokens(spark, d).select("conv_id", "turn", r6(T.rouge(F.col("a"), F.col("b"), "2", "f")).alias("score"))


# The longest common subsequence by rows over the longer side: a cell is the greatest of the one above
# and, over the matches up to it, of one more than the cell above and before the match.
_LCS = f"""{TOKENS}, o AS (SELECT conv_id, turn, len(b) AS m, CASE WHEN len(a) < len(b) THEN b ELSE a END AS l, CASE WHEN len(a) < len(b) THEN a ELSE b END AS s FROM t),
r AS (SELECT conv_id, turn, m, l, s, 0 AS i, list_transform(s, lambda x: 0) AS row FROM o UNION ALL
 SELECT conv_id, turn, m, l, s, i + 1, list_transform(range(1, len(s) + 1), lambda j: greatest(row[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: s[k] = l[i + 1]), lambda k: CASE WHEN k = 1 THEN 0 ELSE row[k - 1] END + 1)), 0))) FROM r WHERE i < len(l))
SELECT conv_id, turn, round(CASE WHEN m = 0 THEN 0.0 ELSE coalesce(list_max(row), 0) / m END, 6) AS score FROM r WHERE i = len(l)""".replace("WITH ", "WITH RECURSIVE ", 1)


@query(_LCS)
def rouge_l_pairs(spark, d):
    return _tokens(spark, d).select("conv_id", "turn", r6(T.rouge_l_recall(F.col("a"), F.col("b"))).alias("score"))


@query(f"{TOKENS} SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN CASE WHEN len(b) = 0 THEN 1.0 ELSE 0.0 END ELSE coalesce(hits, 0) / len(a) END, 6) AS score FROM t LEFT JOIN {hits_sql(1)} USING (conv_id, turn)")
def bleu1_pairs(spark, d):
    return _tokens(spark, d).select("conv_id", "turn", r6(T.bleu_unigram(F.col("a"), F.col("b"))).alias("score"))


_BLEU = f"""{TOKENS}, h AS (SELECT conv_id, turn, len(a) AS c, len(b) AS r, {', '.join(f'coalesce(h{n}.hits, 0) AS h{n}' for n in range(1, 5))} FROM t {' '.join(f'LEFT JOIN {hits_sql(n)} h{n} USING (conv_id, turn)' for n in range(1, 5))})
SELECT conv_id, turn, round(CASE WHEN c = 0 AND r = 0 THEN 1.0 WHEN c < 4 OR r = 0 OR h1 = 0 OR h2 = 0 OR h3 = 0 OR h4 = 0 THEN 0.0
ELSE (CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END) * exp((ln(h1 / c) + ln(h2 / (c - 1)) + ln(h3 / (c - 2)) + ln(h4 / (c - 3))) / 4) END, 6) AS score FROM h"""


@query(_BLEU)
def bleu4_pairs(spark, d):
    return _tokens(spark, d).select("conv_id", "turn", r6(T.bleu(F.col("a"), F.col("b"))).alias("score"))


_CHARS = f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, string_split(translate(regexp_replace(answer, '\\s', '', 'g'), '{T.UPPER}', '{T.LOWER}'), '') AS a,
string_split(translate(regexp_replace(reference, '\\s', '', 'g'), '{T.UPPER}', '{T.LOWER}'), '') AS b FROM pairs)"""


@query(f"{_CHARS} SELECT conv_id, turn, round(2 * coalesce(hits, 0) / (len(a) + len(b)), 6) AS score FROM t LEFT JOIN {hits_sql(1)} USING (conv_id, turn)")
def chrf1_pairs(spark, d):
    return pairs(spark, d).select("conv_id", "turn", r6(T.chrf_unigram(F.col("answer"), F.col("reference"))).alias("score"))


_P = " + ".join(f"coalesce(h{n}.hits, 0) / greatest(len(a) - {n - 1}, 1)" for n in range(1, 7))
_R = " + ".join(f"coalesce(h{n}.hits, 0) / greatest(len(b) - {n - 1}, 1)" for n in range(1, 7))


@query(f"""{_CHARS}, h AS (SELECT conv_id, turn, ({_P}) / least(len(a), len(b), 6) AS p, ({_R}) / least(len(a), len(b), 6) AS r FROM t {' '.join(f'LEFT JOIN {hits_sql(n, "")} h{n} USING (conv_id, turn)' for n in range(1, 7))})
SELECT conv_id, turn, round(CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0.0 END, 6) AS score FROM h""")
def chrf_pairs(spark, d):
    return pairs(spark, d).select("conv_id", "turn", r6(T.chrf(F.col("answer"), F.col("reference"))).alias("score"))


@query("""SELECT doc_id, CAST(contains(d.text, trim(b.text)) AS DOUBLE) AS presence, CAST(trim(d.text) = trim(b.text) AS DOUBLE) AS exact
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def string_presence_docs(spark, d):
    b = table(spark, d, "benchmark")
    n = b.count()
    b = b.select("item_id", F.col("text").alias("ref"))
    b = F.broadcast(b) if n <= 10_000 else b
    x = table(spark, d, "documents").join(b, F.pmod("doc_id", F.lit(n)) == b["item_id"])
    return x.select("doc_id", M.string_presence(F.col("text"), F.col("ref")).alias("presence"), T.exact_match(F.col("text"), F.col("ref")).alias("exact"))


def _names(spark, d):
    p = table(spark, d, "part")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y"))
    return p.select("p_partkey", F.col("p_name").alias("x")).join(q, "p_partkey")


_NAMES = "WITH n AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


@query(f"{_NAMES} SELECT p_partkey, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS score FROM n")
def levenshtein_names(spark, d):
    return _names(spark, d).select("p_partkey", r6(T.levenshtein_similarity(F.col("x"), F.col("y"))).alias("score"))


@query(f"{_NAMES} SELECT p_partkey, round(jaro_similarity(x, y), 6) AS jaro, round(CASE WHEN jaro_similarity(x, y) > 0.7 THEN jaro_winkler_similarity(x, y) ELSE jaro_similarity(x, y) END, 6) AS winkler FROM n")
def jaro_names(spark, d):
    return _names(spark, d).select("p_partkey", r6(T.jaro_similarity("x", "y")).alias("jaro"), r6(T.jaro_winkler_similarity("x", "y")).alias("winkler"))


@query(f"{_NAMES} SELECT p_partkey, round((SELECT count(*) FROM range(1, least(length(x), length(y)) + 1) r(i) WHERE substr(x, i::BIGINT, 1) = substr(y, i::BIGINT, 1)) / greatest(length(x), length(y)), 6) AS score FROM n")
def hamming_names(spark, d):
    return _names(spark, d).select("p_partkey", r6(T.hamming_similarity(F.col("x"), F.col("y"))).alias("score"))


def _retrieval(spark, d):
    """Per conversation its turns as retrieved contexts, and two passages as reference contexts."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("ctx"))
    b = table(spark, d, "benchmark")
    n = b.count()
    b = b.select("item_id", F.col("text").alias("ref"))
    b = F.broadcast(b) if n <= 10_000 else b
    one = c.join(b, F.pmod("conv_id", F.lit(n)) == b["item_id"]).drop("item_id").withColumnRenamed("ref", "r1")
    two = one.join(b, F.pmod(F.col("conv_id") + 1, F.lit(n)) == b["item_id"]).drop("item_id")
    return two.select("conv_id", "ctx", F.array("r1", "ref", F.element_at("ctx", 1)).alias("refs"))


# DuckDB's distance counts bytes: a byte that no text has stands for each character of several bytes.
_BYTES = "".join(chr(i) for i in range(1, 128) if i not in (9, 10, 13) and not 32 <= i < 127)
_NARROW = f"""wide AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)),
z AS MATERIALIZED (SELECT coalesce(string_agg(ch, '' ORDER BY ch), '') AS a FROM wide), cv AS MATERIALIZED (SELECT conv_id, turn, role, translate(text, a, '{_BYTES}') AS text FROM conversations, z), bm AS MATERIALIZED (SELECT item_id, translate(text, a, '{_BYTES}') AS text FROM benchmark, z)"""
_RETRIEVAL = f"""WITH {_NARROW}, c AS (SELECT conv_id, list(text ORDER BY turn, text) AS ctx FROM cv GROUP BY conv_id), n AS (SELECT count(*) AS n FROM bm),
s AS (SELECT conv_id, ctx, [x.text, y.text, ctx[1]] AS refs FROM c, n JOIN bm x ON x.item_id = c.conv_id % n.n JOIN bm y ON y.item_id = (c.conv_id + 1) % n.n),
sim AS (SELECT conv_id, i, j, CASE WHEN greatest(length(ctx[i]), length(refs[j])) = 0 THEN 1.0 ELSE 1 - levenshtein(ctx[i], refs[j]) / greatest(length(ctx[i]), length(refs[j])) END AS v
 FROM (SELECT conv_id, ctx, refs, i, unnest(range(1, len(refs) + 1)) AS j FROM (SELECT conv_id, ctx, refs, unnest(range(1, len(ctx) + 1)) AS i FROM s)))"""


@query(f"""{_RETRIEVAL}, k AS (SELECT conv_id, i, max(v) >= 0.5 AS hit FROM sim GROUP BY ALL), w AS (SELECT conv_id, i, hit, sum(hit::INT) OVER (PARTITION BY conv_id ORDER BY i) AS h FROM k)
SELECT conv_id, round(CASE WHEN sum(hit::INT) = 0 THEN 0.0 ELSE sum(CASE WHEN hit THEN h / i ELSE 0 END) / sum(hit::INT) END, 6) AS score FROM w GROUP BY conv_id""")
def non_llm_context_precision(spark, d):
    return _retrieval(spark, d).select("conv_id", r6(M.context_precision(F.col("ctx"), F.col("refs"))).alias("score"))


@query(f"{_RETRIEVAL}, k AS (SELECT conv_id, j, max(v) >= 0.5 AS hit FROM sim GROUP BY ALL) SELECT conv_id, round(avg(hit::INT), 6) AS score FROM k GROUP BY conv_id")
def non_llm_context_recall(spark, d):
    return _retrieval(spark, d).select("conv_id", r6(M.context_recall(F.col("ctx"), F.col("refs"))).alias("score"))


_IDS = """WITH o AS (SELECT l_orderkey AS k, list((l_partkey % 50)::VARCHAR) AS ids FROM lineitem GROUP BY 1), s AS (SELECT a.k, a.ids AS ret, b.ids AS ref FROM o a JOIN o b ON b.k = a.k + 1)"""


def _ids(spark, d):
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list((F.col("l_partkey") % 50).cast("string")).alias("ids"))
    return o.withColumnRenamed("ids", "ret").join(o.select((F.col("k") - 1).alias("k"), F.col("ids").alias("ref")), "k")


@query(f"{_IDS} SELECT k, round(len(list_filter(ret, lambda x: list_contains(ref, x))) / len(ret), 6) AS precision, round(len(list_intersect(list_distinct(ref), ret)) / len(list_distinct(ref)), 6) AS recall FROM s")
def id_context_scores(spark, d):
    return _ids(spark, d).select("k", r6(M.id_precision(F.col("ret"), F.col("ref"))).alias("precision"), r6(M.id_recall(F.col("ret"), F.col("ref"))).alias("recall"))


@query("""WITH l AS (SELECT doc_id // 10 AS block, doc_id, quality, row_number() OVER w AS k, sum((quality = 1)::INT) OVER w AS h FROM labels WINDOW w AS (PARTITION BY doc_id // 10 ORDER BY doc_id))
SELECT block, round(CASE WHEN sum((quality = 1)::INT) = 0 THEN 0.0 ELSE sum(CASE WHEN quality = 1 THEN h / k ELSE 0 END) / sum((quality = 1)::INT) END, 6) AS score FROM l GROUP BY block""")
def ap_at_k_labels(spark, d):
    g = table(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 10).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "quality"))), lambda x: x["quality"]).alias("v"))
    return g.select("block", r6(V.average_precision(F.col("v"))).alias("score"))


_LEX = f"""WITH {PAIRS}, s AS (SELECT conv_id, turn, [question, answer] AS ctx, reference, answer, question FROM pairs),
cl AS (SELECT conv_id, turn, ctx, {{0}} AS text FROM s), cs AS (SELECT conv_id, turn, ctx, list_filter(list_transform(string_split_regex(text, '[.?!;]'), lambda x: trim(x, ' \n\t\r')), lambda x: x <> '') AS cs FROM cl),
u AS (SELECT conv_id, turn, ctx, i, cs[i] AS c FROM (SELECT conv_id, turn, ctx, cs, unnest(range(1, len(cs) + 1)) AS i FROM cs)),
m AS (SELECT conv_id, turn, i, {meaning_sql('c')} AS ct, {meaning_sql('ctx[1]')} AS c1, {meaning_sql('ctx[2]')} AS c2 FROM u)"""


@query(_LEX.replace("{0}", "reference") + ", k AS (SELECT conv_id, turn, len(ct) > 0 AND len(list_filter(ct, lambda x: NOT list_contains(c1 || c2, x))) = 0 AS hit FROM m) SELECT s.conv_id, s.turn, round(coalesce(avg(hit::INT), 0.0), 6) AS score FROM s LEFT JOIN k USING (conv_id, turn) GROUP BY ALL")
def lexical_context_recall(spark, d):
    return pairs(spark, d).select("conv_id", "turn", r6(M.lexical_context_recall(F.col("reference"), F.array("question", "answer"))).alias("score"))


@query(_LEX.replace("{0}", "answer") + """, k AS (SELECT conv_id, turn, len(ct) > 0 AND len(list_filter(ct, lambda x: NOT list_contains(c1, x))) = 0 AS hit FROM m)
SELECT s.conv_id, s.turn, round(coalesce(avg(hit::INT), 0.0), 6) AS score FROM s LEFT JOIN k USING (conv_id, turn) GROUP BY ALL""")
def lexical_groundedness(spark, d):
    return pairs(spark, d).select("conv_id", "turn", r6(M.lexical_groundedness(F.col("answer"), F.array("question"))).alias("score"))


@query(f"""WITH {PAIRS}, q AS (SELECT conv_id, turn, list_distinct({meaning_sql('question')}) AS q, {meaning_sql('answer')} AS a, {meaning_sql('reference')} AS r FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE (len(list_filter(q, lambda x: list_contains(a, x))) + len(list_filter(q, lambda x: list_contains(r, x)))) / len(q) / 2 END, 6) AS score FROM q""")
def lexical_context_relevance(spark, d):
    return pairs(spark, d).select("conv_id", "turn", r6(M.lexical_context_relevance(F.col("question"), F.array("answer", "reference"))).alias("score"))


@query("""WITH q AS (SELECT doc_id, text, regexp_extract_all(text, '"([^"]*)"', 1) AS q, replace(text, '"', '') AS src FROM documents)
SELECT doc_id, len(q) AS spans, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_filter(q, lambda s: contains(src, s))) / len(q) END, 6) AS score FROM q""")
def quoted_coverage_docs(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.size(T.quoted_texts(F.col("text"))).alias("spans"), r6(T.citation_coverage(F.col("text"), F.array(F.replace("text", F.lit('"'), F.lit(""))))).alias("score"))


@query("""WITH g AS (SELECT l_suppkey AS s, l_returnflag AS f, l_linestatus AS t, l_linenumber AS n, count(*) AS k FROM lineitem GROUP BY ALL),
h AS (SELECT coalesce(a.s, b.s - 1) AS s, sum(least(coalesce(a.k, 0), coalesce(b.k, 0))) AS hits, sum(coalesce(a.k, 0)) AS na, sum(coalesce(b.k, 0)) AS nb
FROM g a FULL JOIN (SELECT * FROM g) b ON b.s = a.s + 1 AND a.f = b.f AND a.t = b.t AND a.n = b.n GROUP BY 1)
SELECT s, hits::BIGINT AS hits, round(hits / na, 6) AS precision, round(hits / nb, 6) AS recall FROM h WHERE na > 0 AND nb > 0""")
def datacompy_lineitem(spark, d):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), *keys)
    m = A.multiset_match(a, a.withColumn("s", F.col("s") - 1), ["s"], keys).where("left > 0 and right > 0")
    return m.select("s", F.col("hits").cast("long").alias("hits"), r6(F.col("hits") / F.col("left")).alias("precision"), r6(F.col("hits") / F.col("right")).alias("recall"))


def _calls(spark, d):
    """Per user all events as tool calls, and those of the next user as expected ones."""
    e = table(spark, d, "events")
    key = F.concat("event_type", F.lit("|"), (F.floor(F.col("value")) % 3).cast("string"))
    u = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", key.alias("c")))), lambda x: x["c"]).alias("calls"))
    return u.withColumnRenamed("calls", "act").join(u.select((F.col("user_id") - 1).alias("user_id"), F.col("calls").alias("exp")), "user_id")


_CALLS = """WITH e AS (SELECT user_id, event_type || '|' || (floor(value)::BIGINT % 3)::VARCHAR AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
p AS (SELECT DISTINCT a.user_id FROM e a JOIN e b ON b.user_id = a.user_id + 1), na AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1)"""


@query(f"""{_CALLS}, h AS (SELECT a.user_id, count(*) AS h FROM e a JOIN e b ON b.user_id = a.user_id + 1 AND a.k = b.k AND a.c = b.c GROUP BY 1)
SELECT p.user_id, round(coalesce(h, 0) / greatest(x.n, y.n), 6) AS score FROM p JOIN na x ON x.user_id = p.user_id JOIN na y ON y.user_id = p.user_id + 1 LEFT JOIN h ON h.user_id = p.user_id""")
def tool_call_accuracy_strict(spark, d):
    return _calls(spark, d).select("user_id", r6(M.tool_call_accuracy(F.col("act"), F.col("exp"))).alias("score"))


@query(f"""{_CALLS}, n AS (SELECT user_id, c, row_number() OVER (PARTITION BY user_id, c ORDER BY k) AS i FROM e), h AS (SELECT a.user_id, count(*) AS h FROM n a JOIN n b ON b.user_id = a.user_id + 1 AND a.c = b.c AND a.i = b.i GROUP BY 1)
SELECT p.user_id, round(coalesce(h, 0) / greatest(x.n, y.n), 6) AS accuracy, round(2 * coalesce(h, 0) / (x.n + y.n), 6) AS f1
FROM p JOIN na x ON x.user_id = p.user_id JOIN na y ON y.user_id = p.user_id + 1 LEFT JOIN h ON h.user_id = p.user_id""")
def tool_call_unordered(spark, d):
    return _calls(spark, d).select("user_id", r6(M.tool_call_accuracy(F.col("act"), F.col("exp"), False)).alias("accuracy"), r6(M.tool_call_f1(F.col("act"), F.col("exp"))).alias("f1"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.35")
def cosine_relationships(spark, d):
    p = G.cosine_pairs(table(spark, d, "embeddings"), 0.35, key="vec_id", vector="embedding")
    return p.select("a", "b", F.round("score", 5).alias("score"))


@query(f"SELECT a.vec_id, (greatest(0, {_COS}) >= 0.1)::DOUBLE AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def semantic_threshold(spark, d):
    e = table(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", V.threshold(V.clamp(V.cosine(F.col("embedding"), F.col("other"))), 0.1).alias("score"))


@query("""WITH i AS (SELECT p_brand AS g, w, count(*) AS c FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY ALL), n AS (SELECT g, sum(c) AS n FROM i GROUP BY 1),
h AS (SELECT a.g AS a, b.g AS b, sum(a.c * b.c) AS h FROM i a JOIN i b ON a.g < b.g AND jaro_winkler_similarity(lower(a.w), lower(b.w)) >= 0.9 GROUP BY ALL)
SELECT a, b, round(h / (x.n * y.n), 6) AS score FROM h JOIN n x ON x.g = a JOIN n y ON y.g = b WHERE h / (x.n * y.n) >= 0.01""")
def entity_overlap(spark, d):
    i = table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.explode(F.split("p_name", " ")).alias("item"))
    return G.entity_overlap(i).select("a", "b", r6(F.col("score")).alias("score"))


def _graph(spark, d):
    """Nations and customers as nodes, nation to customer as edges."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("node_type"), F.create_map(F.lit("name"), "n_name", F.lit("group"), F.col("n_regionkey").cast("string")).alias("props"))
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("ord"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("node_type"), F.create_map(F.lit("name"), "c_name", F.lit("group"), "c_mktsegment").alias("props"))
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("n"), "c_nationkey").alias("source_id"), F.concat(F.lit("c"), "c_custkey").alias("target_id"), F.when(F.col("c_acctbal") > 5000, "rich").otherwise("child").alias("relationship"))
    return n.unionByName(c), e


@query("SELECT c_mktsegment AS key, list('c' || c_custkey ORDER BY c_custkey) AS ids FROM customer GROUP BY 1 UNION ALL SELECT n_regionkey::VARCHAR, list('n' || n_nationkey ORDER BY n_nationkey) FROM nation GROUP BY 1")
def cluster_by_property(spark, d):
    return G.clusters_by_property(_graph(spark, d)[0], F.array(F.col("props")["group"]))


@query("SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 1 AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000)")
def query_graph_advanced(spark, d):
    return G.query(*_graph(spark, d), "nation", "group", "1", "rich").select("id")


@query("SELECT 'n' || c_nationkey AS source_id, 'c' || c_custkey AS target_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <= 2 AND c_mktsegment = 'BUILDING'")
def filter_graph_by_property(spark, d):
    n, e = _graph(spark, d)
    return G.induced(n.where("props['group'] in ('0', '1', '2', 'BUILDING')"), e).select("source_id", "target_id")


@query("SELECT c_custkey AS edge_ord, 'c' || c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 5000")
def graph_neighbors(spark, d):
    return G.neighbors(*_graph(spark, d), "n3", "rich").select("edge_ord", "id", F.col("props")["name"].alias("name"))


@query("SELECT 'n' || c_nationkey AS source_id, 'c' || c_custkey AS target_id FROM customer WHERE c_nationkey NOT IN (1, 2) AND c_mktsegment <> 'BUILDING'")
def remove_graph_nodes(spark, d):
    n, e = _graph(spark, d)
    return G.without(e, n.where("id in ('n1', 'n2') or props['group'] = 'BUILDING'")).select("source_id", "target_id")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), u AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(range(0, len(p))) AS i FROM l))
SELECT doc_id || '-' || i AS source_id, doc_id || '-' || (i + 1) AS target_id, i::INT AS "order" FROM u JOIN (SELECT doc_id, max(i) AS m FROM u GROUP BY 1) USING (doc_id) WHERE i < m""")
def chunk_next_edges(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).select("doc_id", "i", F.concat_ws("-", "doc_id", "i").alias("id"))
    return A.consecutive(p, "doc_id", "i", "id")


_EDGES = "e AS (SELECT DISTINCT 'n' || c_nationkey AS s, 'c' || c_custkey AS t FROM customer), b AS (SELECT s, t FROM e WHERE s <> t UNION SELECT t, s FROM e WHERE s <> t)"


@query(f"""WITH {_EDGES}, p AS (SELECT [s, t] AS p, t FROM b UNION ALL SELECT [x.s, x.t, y.t], y.t FROM b x JOIN b y ON x.t = y.s AND y.t <> x.s)
SELECT DISTINCT list_sort(p) AS nodes FROM p""")
def indirect_cluster_paths(spark, d):
    return G.path_sets(_graph(spark, d)[1], 3)


def _scores(spark, d):
    t = _tokens(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("sample_index"), (F.col("turn") % 4).alias("part"), T.bleu_unigram(F.col("a"), F.col("b")).alias("bleu"), F.when(F.size("a") > 15, T.rouge(F.col("a"), F.col("b"), "1", "r")).alias("rouge"))
    return t.unpivot(["sample_index", "part"], ["bleu", "rouge"], "metric_name", "value")


_SCORES = f"""{TOKENS}, x AS (SELECT conv_id, turn, len(a) AS n, len(b) AS m, coalesce(hits, 0) AS h FROM t LEFT JOIN {hits_sql(1)} USING (conv_id, turn)),
s AS (SELECT turn % 4 AS part, 'bleu' AS metric_name, CASE WHEN n > 0 THEN h / n ELSE 0.0 END AS value FROM x UNION ALL SELECT turn % 4, 'rouge', CASE WHEN n > 15 THEN h / m END FROM x)"""


@query(f"{_SCORES} SELECT metric_name, count(value) AS count, round(coalesce(avg(value), 0.0), 6) AS mean, round(coalesce(stddev_pop(value), 0.0), 6) AS std, count(*) - count(value) AS errors FROM s GROUP BY 1")
def metric_aggregate_report(spark, d):
    return A.report(_scores(spark, d)).select("metric_name", "count", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "errors")


@query(f"""{_SCORES}, a AS (SELECT metric_name, avg(value) AS m FROM s WHERE part < 2 GROUP BY 1), b AS (SELECT metric_name, avg(value) AS m FROM s WHERE part >= 2 GROUP BY 1)
SELECT metric_name, round(coalesce(a.m, 0.0), 6) AS baseline, round(coalesce(b.m, 0.0), 6) AS candidate, round(coalesce(b.m, 0.0) - coalesce(a.m, 0.0), 6) AS delta FROM a FULL JOIN b USING (metric_name)""")
def compare_runs(spark, d):
    s = _scores(spark, d)
    c = A.compare_runs(s.where("part < 2"), s.where("part >= 2"))
    return c.select("metric_name", *[r6(F.col(x)).alias(x) for x in ("baseline", "candidate", "delta")])


def _journal(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("provider"), (F.col("user_id") % 5).cast("string").alias("metric_name"), F.floor("value").alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"), F.lit(None).cast("long").alias("total_tokens"))


@query("""SELECT provider, metric_name, grouping(provider, metric_name)::BIGINT AS level, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens
FROM (SELECT event_type AS provider, (user_id % 5)::VARCHAR AS metric_name, floor(value)::BIGINT AS p, event_id % 100 AS c FROM events) GROUP BY GROUPING SETS ((), (provider), (metric_name))""")
def usage_grouping_sets(spark, d):
    return A.usage(_journal(spark, d))


@query("""WITH s AS (SELECT event_type AS model, sum(floor(value)::BIGINT) AS p, sum(event_id % 100) AS c FROM events GROUP BY 1)
SELECT model, round(p / 1000 * 0.5 + c / 1000 * 1.5, 6) AS cost FROM s""")
def usage_cost(spark, d):
    calls = _journal(spark, d).withColumnRenamed("provider", "model")
    rates = calls.select("model").distinct().select("model", F.lit(0.5).alias("input_rate"), F.lit(1.5).alias("output_rate"))
    return A.model_cost(calls, rates, 1000).select("model", r6(F.col("cost")).alias("cost"))


@query("""WITH i AS (SELECT p_partkey * 10 + k AS position, w[k] AS item FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))),
c AS (SELECT item, count(*) AS n, min(position) AS first FROM i GROUP BY 1) SELECT item, n FROM c ORDER BY n DESC, first, item LIMIT (SELECT greatest(1, trunc(count(*) * 0.05)::BIGINT) FROM c)""")
def noisy_entities(spark, d):
    i = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("k", "item")).select((F.col("p_partkey") * 10 + F.col("k") + 1).alias("position"), "item")
    return A.frequent_items(i).select("item", "n")


@query("""WITH s AS (SELECT avg((n_chars > 2000)::INT) AS l, avg((n_chars > 400 AND n_chars <= 2000)::INT) AS m FROM documents)
SELECT round(l, 6) AS long_share, round(m, 6) AS middle_share, CASE WHEN l >= 0.25 THEN 'split' WHEN m >= 0.25 THEN 'no_split' ELSE 'none' END AS branch FROM s""")
def doc_length_branch(spark, d):
    return A.transform_branch(table(spark, d, "documents"), F.col("n_chars")).select(r6(F.col("long_share")).alias("long_share"), r6(F.col("middle_share")).alias("middle_share"), "branch")


@query(f"""WITH {PAIRS}, s AS (SELECT conv_id * 1000 + turn AS sample_index, CASE WHEN conv_id % 7 = 0 THEN ' ' ELSE question END AS q, CASE WHEN turn % 5 = 0 THEN '' ELSE answer END AS a, conv_id % 3 AS c FROM pairs)
SELECT sample_index, 'user_input' AS field FROM s WHERE trim(q) = '' UNION ALL SELECT sample_index, 'response' FROM s WHERE trim(a) = '' UNION ALL SELECT sample_index, 'retrieved_contexts' FROM s WHERE c = 0""")
def validation_issues(spark, d):
    from assayer.sources.datasets import issues

    s = pairs(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_index"), F.when(F.col("conv_id") % 7 == 0, " ").otherwise(F.col("question")).alias("user_input"), F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("answer")).alias("response"), F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(" "))).otherwise(F.array("reference")).alias("retrieved_contexts"))
    return issues(s).select("sample_index", "field")


@query("""SELECT doc_id, len(string_split_regex(trim(text, ' \n\t\r'), '\\s+')) AS tokens, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: trim(x, ' \n\t\r')), lambda x: x <> '')) AS sentences FROM documents WHERE trim(text, ' \n\t\r') <> ''""")
def text_counts(spark, d):
    t = table(spark, d, "documents").where(~T.is_blank(F.col("text")))
    return t.select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"), F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


# Chunks closed so far and the bytes of the open one, as one number.
@query("""WITH w AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x: strlen(x)::BIGINT) AS n FROM documents),
c AS (SELECT doc_id, list_reduce(n, lambda a, x: CASE WHEN a % 10000000 + 1 + x > 256 THEN (a // 10000000 + 1) * 10000000 + x ELSE a + 1 + x END) // 10000000 + 1 AS chunks FROM w WHERE len(n) > 0)
SELECT doc_id || '-chunk-' || i AS id, doc_id::VARCHAR AS source_id, i::INT AS chunk_index FROM (SELECT doc_id, unnest(range(chunks)) AS i FROM c)""")
def chunk_documents_bytes(spark, d):
    return chunk_documents(table(spark, d, "documents"), 256).drop("text")


def _samples(spark, d):
    return pairs(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_index"), F.col("question").alias("user_input"), F.col("answer").alias("response"), F.array("question", "reference").alias("retrieved_contexts"), "reference")


def _kept(spark):
    """Materialises a stage so that its calls are made once: a checkpoint where the session names a
    folder for it, else a cached table."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return lambda df: df.checkpoint()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return lambda df: df.cache()


@query(f"""WITH {PAIRS}, s AS (SELECT conv_id * 1000 + turn AS sample_index, list_filter(list_transform(string_split(answer, '.'), lambda x: trim(x, ' \n\t\r')), lambda x: x <> '') AS s, string_split_regex(lower(question || chr(10) || reference), '\\s+') AS k FROM pairs)
SELECT sample_index, round(CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: len(list_intersect(list_filter(string_split_regex(lower(x), '\\s+'), lambda y: y <> ''), k)) > 0)) / len(s) END, 6) AS score, NULL::VARCHAR AS error FROM s""")
def faithfulness_scripted(spark, d):
    return judges.faithfulness(_samples(spark, d), Scripted(rule_judge), _kept(spark)).select("sample_index", r6(F.nanvl("value", F.lit(None).cast("double"))).alias("score"), "error")


@query()
def semantic_similarity_hashed(spark, d):
    return judges.semantic_similarity(_samples(spark, d), HashEmbedding(), _kept(spark)).select("sample_index", r6(F.col("value")).alias("score"))


_NARROW_PAIRS = PAIRS.replace("FROM conversations", "FROM cv").replace("JOIN benchmark b", "JOIN bm b").replace("count(*) FROM benchmark", "count(*) FROM bm")


@query(f"""WITH {_NARROW}, {_NARROW_PAIRS} SELECT conv_id * 1000 + turn AS sample_index, CAST(trim(answer) = trim(reference) AS DOUBLE) AS exact_match,
round(1 - levenshtein(answer, reference) / greatest(length(answer), length(reference), 1), 6) AS string_similarity FROM pairs""")
def evaluate_native(spark, d):
    s = evaluate(_samples(spark, d), ["exact_match", "string_similarity"])
    return s.groupBy("sample_index").pivot("metric_name", ["exact_match", "string_similarity"]).agg(F.first("value")).select("sample_index", "exact_match", r6(F.col("string_similarity")).alias("string_similarity"))


@query("""WITH e AS (SELECT vec_id, embedding AS v, label, (vec_id % 7)::DOUBLE / 4 - 0.25 AS raw FROM embeddings),
g AS (SELECT vec_id, v, label, raw, least(1, greatest(0, raw)) AS c, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)))::FLOAT AS norm, (vec_id % 5)::INT AS tp, (vec_id % 3)::INT AS fp FROM e)
SELECT vec_id, c AS clamped, CASE WHEN raw BETWEEN 0 AND 1 THEN raw END AS accepted, CASE WHEN raw BETWEEN 0 AND 1 THEN NULL ELSE 'metric task failed: the score is not in [0, 1]' END AS error,
 (c >= 0.5)::DOUBLE AS critic, round(CASE WHEN norm > 0 THEN list_sum(list_transform(v, lambda x: (x::FLOAT / norm)::DOUBLE)) ELSE 0 END, 3) + 0.0::DOUBLE AS unit_sum, (len(list_filter(v, lambda x: x <> 0)) = 0) AS zero,
 round(CASE WHEN 2 * tp + fp + label > 0 THEN 2 * tp / (2 * tp + fp + label) ELSE 0.0 END, 6) AS f1, round((c * 0.25 + tp / 4 * 0.75), 6) AS correctness, round(greatest(0, c - tp / 4), 6) AS noise,
 round(CASE WHEN fp = 0 THEN 1.0 ELSE least(tp, fp) / fp END, 6) AS share, printf('%.6f', raw) AS printed FROM g""")
def score_helpers(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label", ((F.col("vec_id") % 7).cast("double") / 4 - 0.25).alias("raw"), (F.col("vec_id") % 5).cast("int").alias("tp"), (F.col("vec_id") % 3).cast("int").alias("fp"))
    made, c = M.numeric_result(F.col("raw")), V.normalized_score(F.col("raw"))
    return e.select(
        "vec_id", c.alias("clamped"), V.normalized_score(F.col("raw"), "reject").alias("accepted"), made["error"].alias("error"), M.aspect_critic(F.col("raw"), 0.5).alias("critic"),
        (F.round(F.aggregate(V.l2_normalized(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 3) + 0.0).alias("unit_sum"), V.is_zero(F.col("embedding")).alias("zero"),
        r6(V.f1(F.col("tp"), F.col("fp"), F.col("label"))).alias("f1"), r6(V.answer_correctness(F.col("raw"), F.col("tp") / 4)).alias("correctness"), r6(V.noise_sensitivity(F.col("raw"), F.col("tp") / 4)).alias("noise"),
        r6(M.ratio(F.least("tp", "fp"), F.col("fp"), 1.0)).alias("share"), G.printed(F.col("raw")).alias("printed"),
    )


@query("""WITH o AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"score": 0.5, "reason": "fine"}' WHEN 1 THEN 'so {"score": 1} it is' WHEN 2 THEN '{"score": "high"}' WHEN 3 THEN '{"score": 2, "reason": 7}' ELSE 'none' END AS j, event_id % 5 AS k, value, event_type FROM events)
SELECT event_id, CASE k WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS score, CASE k WHEN 0 THEN 'fine' END AS reason, k = 1 AS repaired, k NOT IN (0, 1) AS failed, CASE WHEN event_id % 4 < 3 THEN round((event_id % 4 / 2 + 0.5) / 2, 6) END AS summary,
 CASE WHEN event_id % 2 = 0 THEN '[text] ' || event_type || chr(10) || '[image image/png] u' END AS scaffold FROM o""")
def judge_outputs(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 5).alias("k"), (F.col("event_id") % 4).alias("m"))
    says = F.when(F.col("k") == 0, '{"score": 0.5, "reason": "fine"}').when(F.col("k") == 1, 'so {"score": 1} it is').when(F.col("k") == 2, '{"score": "high"}').when(F.col("k") == 3, '{"score": 2, "reason": 7}').otherwise("none")
    e = e.withColumn("j", M.judge_score(says, repair=True)).withColumn("s", M.summarization_score(F.concat(F.lit('{"coverage": '), (F.col("m") / 2).cast("string"), F.lit(', "conciseness": 0.5}'))))
    part = lambda kind, text, mime: F.struct(F.lit(kind).alias("kind"), text.alias("text"), mime.alias("mime"))
    parts = F.array(part("text", F.col("event_type"), F.lit(None).cast("string")), part("image", F.lit("u"), F.when(F.col("event_id") % 2 == 0, "image/png").otherwise("image/tiff")))
    return e.select("event_id", "j.score", "j.reason", "j.repaired", F.col("j.error").isNotNull().alias("failed"), r6(F.col("s.value")).alias("summary"), M.prompt_scaffold(parts).alias("scaffold"))


@query("""WITH l AS (SELECT doc_id, text, string_split_regex(text, '[.?!;]') AS c, regexp_extract_all(text, '(?m)^#{1,6}[^\\S\\n]+(\\S[^\\n]*)$', 1) AS h FROM documents)
SELECT doc_id, len(list_filter(list_transform(c, lambda x: trim(x, ' \n\t\r')), lambda x: x <> ''))::INT AS claims, len(h)::INT AS headings,
 CASE WHEN length(text) <= 10 THEN '***' ELSE substr(text, 1, 6) || '...' || right(text, 4) END AS masked, length(regexp_replace(text, '[ \t\n\r\f;]', '', 'g')) AS squeezed FROM l""")
def text_helpers(spark, d):
    t, c = table(spark, d, "documents"), F.col("text")
    return t.select("doc_id", F.size(T.claims(c)).alias("claims"), F.size(T.headings(c)).alias("headings"), T.mask_secret(c).alias("masked"), F.char_length(T.squeeze_sql(c)).cast("long").alias("squeezed"))


@query("""WITH c AS (SELECT c_custkey AS ord, least('n' || c_nationkey, 'c' || c_custkey % 40) AS a, greatest('n' || c_nationkey, 'c' || c_custkey % 40) AS b FROM customer) SELECT a, b, min(ord) AS ord FROM c WHERE a <> b GROUP BY ALL""")
def first_edges(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("n"), "c_nationkey").alias("source_id"), F.concat(F.lit("c"), (F.col("c_custkey") % 40).cast("string")).alias("target_id"))
    return G.first_edge_per_pair(e).select("a", "b", "ord")


@query("""SELECT 'c' || c_custkey AS id, n_name AS parent_summary FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal <= 5000""")
def parent_summaries(spark, d):
    n, e = _graph(spark, d)
    n = n.withColumn("props", F.create_map(F.lit("summary"), F.col("props")["name"]))
    return G.parent_summary(n, e).where("node_type = 'customer'").select("id", "parent_summary")


@query("""WITH h AS (SELECT l_suppkey % 10 AS s, list(DISTINCT l_linenumber) AS x FROM lineitem WHERE l_quantity > 49 GROUP BY 1)
SELECT s, len(list_filter(x, lambda v: v NOT IN (1, 2, 3, 4))) = 0 AS inside FROM h""")
def id_subsets(spark, d):
    h = table(spark, d, "lineitem").where("l_quantity > 49").groupBy((F.col("l_suppkey") % 10).alias("s")).agg(F.collect_set("l_linenumber").alias("x"))
    return h.select("s", A.subset_of(F.col("x"), F.array(*map(F.lit, range(1, 5)))).alias("inside"))


@query("""SELECT round(sum(floor(value)::BIGINT)::DOUBLE * 0.25::DOUBLE + sum(event_id % 100)::DOUBLE * 0.25::DOUBLE, 6) AS cost FROM events""")
def run_cost(spark, d):
    return A.estimated_cost(_journal(spark, d), 0.25).select(r6(F.col("cost")).alias("cost"))


@query(f"""{_SCORES} SELECT 'nightly' AS experiment, metric_name, round(avg(value), 6) AS mean, 'x' AS model FROM s WHERE value IS NOT NULL GROUP BY 2""")
def experiment_summary(spark, d):
    return A.summarize(_scores(spark, d), "nightly", {"model": "x"}).select("experiment", "metric_name", r6(F.col("mean")).alias("mean"), F.col("metadata")["model"].alias("model"))


@query("""SELECT c_custkey, array_to_string(list_transform(list_filter([CASE WHEN c_acctbal > 0 THEN 'authorization' END, 'note'], lambda k: k IS NOT NULL), lambda k: k || '=' || CASE WHEN k = 'authorization' THEN '[REDACTED]' ELSE c_name END), ',') AS shown FROM customer""")
def redacted_fields(spark, d):
    m = F.create_map(F.lit("authorization"), F.when(F.col("c_acctbal") > 0, F.lit("abc")), F.lit("note"), F.col("c_name"))
    m = F.map_filter(m, lambda _, v: v.isNotNull())
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(T.redact_map(m))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("shown"))


@query("""WITH n AS (SELECT 'n' || n_nationkey AS id, 'document' AS t, n_regionkey > 0 AS has FROM nation UNION ALL SELECT 'c' || c_custkey, 'chunk', c_acctbal > 9000 FROM customer), k AS (SELECT count(*) FILTER (WHERE t = 'chunk') AS c, count(*) FILTER (WHERE t = 'document') AS d FROM n WHERE has)
SELECT id FROM n, k WHERE has AND t = CASE WHEN c > d THEN 'chunk' ELSE 'document' END""")
def entity_node_choice(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    held = lambda c: F.create_map(F.lit("entities"), F.when(c, '["x"]').otherwise("[]"))
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("document").alias("node_type"), held(F.col("n_regionkey") > 0).alias("props"))
    return G.entity_nodes(nodes.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("chunk").alias("node_type"), held(F.col("c_acctbal") > 9000).alias("props")))).select("id")


@query("""WITH w AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x: strlen(x)::BIGINT) AS n FROM documents),
c AS (SELECT doc_id, list_reduce(n, lambda a, x: CASE WHEN a % 10000000 + 1 + x > 1000 THEN (a // 10000000 + 1) * 10000000 + x ELSE a + 1 + x END) // 10000000 + 1 AS chunks FROM w WHERE len(n) > 0)
SELECT doc_id || '-chunk-' || i AS source_node_ids, 'single-hop' AS synthesis_type FROM (SELECT doc_id, unnest(range(chunks)) AS i FROM c)
UNION ALL SELECT doc_id || '-chunk-' || i || ',' || doc_id || '-chunk-' || (i + 1), 'multi-hop' FROM (SELECT doc_id, unnest(range(chunks - 1)) AS i FROM c)""")
def testset_scripted(spark, d):
    from assayer.plans.transforms import generate_testset

    return generate_testset(table(spark, d, "documents"), Scripted(lambda p: '{"question": "what?", "answer": "that"}'), _kept(spark)).select("source_node_ids", "synthesis_type")
