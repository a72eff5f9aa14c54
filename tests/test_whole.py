"""Registered queries over whole inputs, against brute force of the test's own."""

from collections import Counter
from itertools import combinations
from random import Random

import duckdb
from pyspark.sql import functions as F

from assayer import catalog
from assayer.operators import graph as G
from assayer.sources import datasets


def sql(small, text):
    return duckdb.sql(text.replace("@", small)).fetchall()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_retrieval_compares_whole_texts(spark, small):
    turns, passages = {}, dict(sql(small, "SELECT item_id, text FROM '@/benchmark.parquet'"))
    for c, text in sql(small, "SELECT conv_id, text FROM '@/conversations.parquet' ORDER BY conv_id, turn, text"):
        turns.setdefault(c, []).append(text)
    assert max(len(t) for x in turns.values() for t in x) > 200
    n, precision, recall = len(passages), {}, {}
    for c, ctx in turns.items():
        refs = [passages[c % n], passages[(c + 1) % n], ctx[0]]
        hit = [[max(len(x), len(y)) == 0 or 1 - edits(x, y) / max(len(x), len(y)) >= 0.5 for y in refs] for x in ctx]
        good = [any(h) for h in hit]
        precision[c] = round(sum(sum(good[: i + 1]) / (i + 1) for i, g in enumerate(good) if g) / max(1, sum(good)), 6)
        recall[c] = round(sum(any(h[j] for h in hit) for j in range(3)) / 3, 6)
    assert {r["conv_id"]: r["score"] for r in catalog.QUERIES["non_llm_context_precision"](spark, small).collect()} == precision
    assert {r["conv_id"]: r["score"] for r in catalog.QUERIES["non_llm_context_recall"](spark, small).collect()} == recall
    assert all(len(t) > 200 for r in catalog._retrieval(spark, small).collect() for t, whole in zip(r["ctx"], turns[r["conv_id"]], strict=True) if len(whole) > 200)


def test_tool_calls_score_every_event(spark, small):
    calls, strict, unordered = {}, {}, {}
    for u, c in sql(small, "SELECT user_id, event_type || '|' || (floor(value)::BIGINT % 3)::VARCHAR FROM '@/events.parquet' ORDER BY user_id, ts, event_id"):
        calls.setdefault(u, []).append(c)
    assert max(map(len, calls.values())) > 5
    for u, act in calls.items():
        if exp := calls.get(u + 1):
            hits, most = (Counter(act) & Counter(exp)).total(), max(len(act), len(exp))
            strict[u] = round(sum(x == y for x, y in zip(act, exp)) / most, 6)  # noqa: B905
            unordered[u] = (round(hits / most, 6), round(2 * hits / (len(act) + len(exp)), 6))
    assert {r["user_id"]: r["score"] for r in catalog.QUERIES["tool_call_accuracy_strict"](spark, small).collect()} == strict
    assert {r["user_id"]: (r["accuracy"], r["f1"]) for r in catalog.QUERIES["tool_call_unordered"](spark, small).collect()} == unordered


def test_paths_run_over_every_customer(spark, small):
    near = {}
    for n, c in sql(small, "SELECT 'n' || c_nationkey, 'c' || c_custkey FROM '@/customer.parquet'"):
        near.setdefault(n, set()).add(c)
    want = {frozenset((n, c)) for n, cs in near.items() for c in cs} | {frozenset((n, *p)) for n, cs in near.items() for p in combinations(cs, 2)}
    got = [r["nodes"] for r in catalog.QUERIES["indirect_cluster_paths"](spark, small).collect()]
    assert all(x == sorted(x) for x in got)
    assert len(got) == len(want) and {frozenset(x) for x in got} == want


def paths(edges, depth, bidirectional):
    near = {}
    for s, t in edges:
        if s != t:
            near.setdefault(s, set()).add(t)
            if bidirectional:
                near.setdefault(t, set()).add(s)
    level, out = [(s, t) for s, ts in near.items() for t in ts], set()
    for n in range(2, depth + 1):
        out |= {tuple(sorted(p)) for p in level}
        level = [(*p, t) for p in level for t in near.get(p[-1], ()) if t not in p] if n < depth else []
    return sorted(out)


def test_path_sets_are_made_once_and_whole(spark):
    rng = Random(3)
    clique = [(f"k{i}", f"k{j}") for i, j in combinations(range(9), 2)]
    loose = [(f"x{rng.randrange(40)}", f"x{rng.randrange(40)}") for _ in range(150)]
    star = [("hub", f"l{i}") for i in range(30)] + [("l1", "l2"), ("l2", "l1"), ("l2", "l3"), ("l1", "l3"), ("k1", "hub"), ("hub", "hub")]
    for edges in ([("a", "b")], [("a", "a")], star, clique + loose + star):
        df = spark.createDataFrame(edges + edges[:3], "source_id string, target_id string")
        for depth, both in ((2, True), (3, True), (4, True), (2, False), (3, False), (4, False)):
            got = sorted(tuple(r["nodes"]) for r in G.path_sets(df, depth, both).collect())
            assert got == paths(edges, depth, both), (len(edges), depth, both)
    e = df.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"))
    e = e.union(e.select("t", "s")).where("s <> t").distinct()
    cut = sorted(tuple(r["nodes"]) for r in G._triples(e, block=4, rows=50).collect())
    assert cut == [p for p in paths(edges, 3, True) if len(p) == 3]


def test_sets_of_a_hub_are_not_shuffled_and_are_many_tasks_work(spark):
    star = spark.range(3000).select(F.lit("hub").alias("source_id"), F.concat(F.lit("l"), "id").alias("target_id"))
    df = G.path_sets(star, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "keys=[nodes" not in plan and "partitioning(nodes" not in plan
    parts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 3000 + 3000 * 2999 // 2 and max(parts) < sum(parts) / 2


def test_csv_has_every_metadata_key(spark, tmp_path):
    df = spark.range(1).selectExpr("'q' user_input", "'a' response", "array('c') retrieved_contexts", "'r' reference", "map_from_entries(transform(sequence(1, 1005), i -> struct(concat('k', i) as k, string(i) as v))) metadata")
    datasets.write_csv(df, str(tmp_path / "out"))
    head = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()[0]
    assert head.count("metadata.k") == 1005
