"""Transform pipelines and test sets with scripted answers."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import graph as G
from assayer.plans import testset as S
from assayer.plans import transforms as T
from assayer.plans.providers import HashEmbedding, ProviderError, Scripted, stored


def script(prompt):
    """A model by rules: entities and themes are capitalised words."""
    head, _, rest = prompt.partition(": ")
    names = sorted({w.strip(".,") for w in rest.split() if w[:1].isupper()})
    if head == "extract entities":
        return json.dumps({"entities": names})
    if head == "extract themes":
        return json.dumps({"output": names})
    if head == "extract summary":
        return json.dumps({"text": rest[:60]})
    if head == "extract headlines":
        return json.dumps({"headlines": [x for x in rest.split("\n") if x.startswith("Part")]})
    if head.startswith("score 1 to 5"):
        return json.dumps({"score": 1 if "worthless" in prompt else 5})
    if head == "persona for":
        return json.dumps({"name": "Ada", "role_description": "reads"})
    if head == "themes to personas":
        return json.dumps({"mapping": {"Ada": json.loads(prompt.split(": ", 1)[1].split("\npersonas: ")[0])}})
    if "combinations of" in head:
        return json.dumps({"combinations": [[t[0] for t in json.loads(rest) if t]]})
    if head.startswith("question and answer"):
        return json.dumps({"query": "q?", "answer": "a."})
    if head.startswith("question from"):
        return 'Sure: {"question": "q' + str(len(rest)) + '", "answer": "a"} and {no json}'
    raise ValueError(head)


@pytest.fixture
def keep(tmp_path):
    return stored(f"file://{tmp_path}")


def graph_of(spark, texts):
    nodes = spark.createDataFrame([(i, f"d{i}", "document", {"text": t}) for i, t in enumerate(texts)], "ord long, id string, node_type string, props map<string,string>")
    return nodes, spark.createDataFrame([], "ord long, source_id string, target_id string, relationship string, props map<string,string>")


LONG = ["Part one\n" + "Berlin and Paris are towns. " * 90 + "\nPart two\n" + "Rome is a town too. " * 130, "Part one\n" + "Paris and Oslo are towns. " * 90 + "\nPart two\n" + "worthless words " * 150]


def test_default_transforms_split_filter_and_link(spark, keep):
    nodes, edges = T.default_transforms(graph_of(spark, LONG), Scripted(script), HashEmbedding(), keep)
    chunk = {r["id"]: r["props"] for r in nodes.where("node_type = 'chunk'").collect()}
    assert set(chunk) == {"d0-chunk-0", "d0-chunk-1", "d1-chunk-0"}  # the worthless one is gone
    assert json.loads(chunk["d0-chunk-0"]["entities"]) == ["Berlin", "Paris", "Part"]
    kinds = {(r["source_id"], r["target_id"], r["relationship"]) for r in edges.collect()}
    assert {("d0", "d0-chunk-0", "child"), ("d0-chunk-0", "d0-chunk-1", "next"), ("d1", "d1-chunk-0", "child")} <= kinds
    assert any(k == "entities_overlap" for *_, k in kinds) and not any("d1-chunk-1" in x[:2] for x in kinds)
    assert T.available((nodes, edges))[0] == T.SINGLE and T.SPECIFIC in T.available((nodes, edges))


def test_default_transforms_of_middling_and_short_documents(spark, keep):
    llm, emb = Scripted(script), HashEmbedding()
    nodes, edges = T.default_transforms(graph_of(spark, ["Berlin is a town. " * 30, "Berlin is a town. " * 31]), llm, emb, keep)
    assert {r["relationship"] for r in edges.collect()} >= {"cosine_similarity"}
    assert all("summary_embedding" in r["props"] for r in nodes.collect())
    with pytest.raises(ValueError):
        T.default_transforms(graph_of(spark, ["short"]), llm, emb, keep)
    with pytest.raises(ValueError):
        T.default_transforms(graph_of(spark, []), llm, emb, keep)
    sample = T.Generator((nodes, edges), llm, keep).generate(4)
    assert 0 < sample.count() <= 4 and set(r["synthesizer_name"] for r in sample.collect()) <= {T.SINGLE, T.ABSTRACT, T.SPECIFIC}
    with pytest.raises(ValueError):
        T.default_distribution(graph_of(spark, ["nothing extracted"]))


def test_steps_extractors_and_errors(spark, keep):
    nodes, edges = graph_of(spark, ["Oslo", " "])
    llm = Scripted(script)
    got = {r["id"]: (r["entities"], r["themes"], r["summary"]) for r in S.extract_bundle(nodes, llm, keep).collect()}
    assert got == {"d0": (["Oslo"], ["Oslo"], "Oslo"), "d1": ([], [], "")}
    done = S.attach_extractions(nodes, S.extract_bundle(nodes, llm, keep)).where("id = 'd0'").first()["props"]
    assert json.loads(done["entities"]) == ["Oslo"] and done["summary"] == "Oslo"
    with pytest.raises(ProviderError):
        S.extract(nodes, "title", Scripted(lambda p: "no json"), keep)
    with pytest.raises(ValueError, match="no property summary"):
        S.embed(nodes, HashEmbedding(), keep, "summary")
    assert len(json.loads(S.embed(nodes, HashEmbedding(8), keep).first()["props"]["embedding"])) == 8
    bundle = spark.createDataFrame([("a", '{"entities": ["x"], "themes": [], "summary": "s"}')], "id string, answer string")
    assert tuple(S.parse_bundle(bundle).first()) == ("a", ["x"], [], "s")
    with pytest.raises(ProviderError):
        S.parse_bundle(bundle.withColumn("answer", F.lit("x")))
    twice = T.apply_transforms((nodes, edges), [[T.extraction("summary", llm, keep, "document")], lambda g: (g[0].limit(1), g[1])])
    assert twice[0].count() == 1 and "summary" in twice[0].first()["props"]


def test_long_texts_are_extracted_in_pieces(spark, keep):
    nodes, _ = graph_of(spark, ["Alpha " + "word " * 8000 + "Omega"])
    value = S.extract(nodes, "entities", Scripted(script), keep).first()["value"]
    assert value == ["Alpha", "Omega"]


def test_testset_from_raw_texts(spark, keep):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "seven")], "doc_id long, text string")
    got = T.generate_testset(docs, Scripted(script), keep, most_bytes=14).collect()
    assert sorted((r["source_node_ids"], r["synthesis_type"]) for r in got) == [("1-chunk-0", "single-hop"), ("1-chunk-0,1-chunk-1", "multi-hop"), ("1-chunk-1", "single-hop"), ("2-chunk-0", "single-hop")]
    assert T.generate_testset(docs, Scripted(script), keep, multi_hop=False, most_bytes=14).count() == 3
    with pytest.raises(ValueError):
        T.generate_testset(docs.where("false"), Scripted(script), keep)


def test_one_repair_round(spark, keep):
    replies = {"p": "broken {", "q": '{"v": 1}'}

    def answer(prompt):
        if prompt.startswith("repair"):
            return '{"text": "{\\"v\\": 7}"}'
        return replies[prompt]

    from assayer.plans.judges import ask

    df = spark.createDataFrame([("p",), ("q",)], "x string")
    got = {r["x"]: (r["got"]["v"], r["failed"]) for r in ask(df, Scripted(answer), keep, F.col("x"), F.lit(True), "v int").collect()}
    assert got == {"p": (7, None), "q": (1, None)}


def brute_clusters(edges, n, depth, both):
    near, pairs, nodes = {}, set(), set()
    for s, t in edges:
        near.setdefault(s, set()).add(t)
        if both:
            near.setdefault(t, set()).add(s)
        pairs.add(tuple(sorted((s, t))))
        nodes |= {s, t}
    size = (n - 1) * depth + 1 if len(pairs) < len(nodes) else max(n, depth, 10)
    buckets = []
    for start in sorted(near)[:size]:
        found = []

        def walk(path):
            if len({*found}) > size:
                return
            after = [t for t in sorted(near.get(path[-1], ())) if t not in path]
            if len(path) > 1 and (len(path) >= depth or not after):
                found.append(frozenset(path))
            else:
                for t in after:
                    walk([*path, t])

        walk([start])
        if found:
            buckets.append(sorted(map(sorted, set(found))))
    out, i = [], 0
    while len(out) < n and buckets:
        at = i % len(buckets)
        c = set(buckets[at].pop(0))
        if not any(c <= x for x in out):
            out = [x for x in out if not x <= c] + [c]
        if buckets[at]:
            i += 1
        else:
            buckets.pop(at)
    return out


@pytest.mark.parametrize("n,depth,both", [(1, 2, True), (3, 3, True), (5, 3, False), (4, 4, True)])
def test_path_clusters(spark, n, depth, both):
    import random

    rng = random.Random(n)
    for size in (8, 30):
        edges = [(f"n{rng.randrange(size)}", f"n{rng.randrange(size)}") for _ in range(rng.choice([5, 25]))]
        df = spark.createDataFrame(edges, "source_id string, target_id string")
        assert G.path_clusters(df, n, depth, both) == brute_clusters(edges, n, depth, both)
    with pytest.raises(ValueError):
        G.path_clusters(df, 1, 1)
    with pytest.raises(ValueError):
        G.path_clusters(df.limit(0), 1, 2)


def test_graph_additions(spark):
    nodes, edges = graph_of(spark, ["a", "b"])
    more = spark.createDataFrame([(0, "d0", "chunk", {"entities": '["x"]'})], nodes.schema)
    both = G.with_nodes(nodes, more)
    assert [(r["ord"], r["id"]) for r in both.orderBy("ord").collect()] == [(0, "d0"), (1, "d1"), (2, "d0")]
    assert G.node_by_id(both, "d0").first()["node_type"] == "document"
    assert [r["node_type"] for r in G.entity_nodes(both).collect()] == ["chunk"]
    assert G.nodes_with_property(both, "entities", "x").count() == 1 and G.nodes_with_property(both, "text", '["a", "z"]').count() == 1
    items = spark.createDataFrame([("p", "Alpha"), ("p", "Alpha"), ("p", "beta"), ("q", "alpha"), ("r", "zzz")], "grp string, item string")
    assert {(r["a"], r["b"]): round(r["score"], 6) for r in G.entity_overlap(items, 0.9, 0.0).collect()} == {("p", "q"): 0.666667, ("p", "r"): 0.0, ("q", "r"): 0.0}
