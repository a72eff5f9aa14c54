"""Golden values, oracles on the smallest tables, and behaviour of sources, stages and plans."""

import math

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayer import catalog
from assayer.functions import metrics as M
from assayer.functions import text as T
from assayer.functions import vector as V
from assayer.operators import aggregates as A
from assayer.operators import chunking, graph
from assayer.plans import evaluate, judges, optimize, providers, testset
from assayer.sources import datasets

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "measure,a,b,want",
    [
        ("levenshtein", "kitten", "sitting", 4 / 7), ("hamming", "karolin", "kathrin", 4 / 7), ("hamming", "abc", "abcd", 3 / 4), ("hamming", "color", "colour", 2 / 3),
        ("jaro", "MARTHA", "MARHTA", 17 / 18), ("jaro", "DWAYNE", "DUANE", 37 / 45), ("jaro", "DIXON", "DICKSONX", 23 / 30), ("jaro_winkler", "MARTHA", "MARHTA", 173 / 180),
        ("jaro_winkler", "DWAYNE", "DUANE", 21 / 25), ("jaro_winkler", "DIXON", "DICKSONX", 61 / 75), ("jaro_winkler", "abcde12345", "abcde67890", 2 / 3),
        ("levenshtein", "", "", 1.0), ("hamming", "abc", "", 0.0), ("jaro", "", "", 1.0), ("jaro_winkler", "abc", "", 0.0), ("levenshtein", "ABC", "abc", 0.0), ("levenshtein", "Abc", "abc", 2 / 3),
    ],
)
def test_distances(spark, measure, a, b, want):
    assert one(spark, T.string_similarity(F.col("a"), F.col("b"), measure), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize(
    "a,b,kind,p,r,f",
    [("the cat sat", "the cat sat on the mat", "1", 1, 1 / 2, 2 / 3), ("the cat sat", "the cat sat on the mat", "2", 1, 2 / 5, 4 / 7), ("a c", "a b c d", "l", 1, 1 / 2, 2 / 3), ("the the", "the the the", "1", 1, 2 / 3, 4 / 5), ("", "", "l", 0, 0, 0)],
)
def test_rouge(spark, a, b, kind, p, r, f):
    t = (T.ws_tokens(F.col("a")), T.ws_tokens(F.col("b")))
    for mode, want in zip("prf", (p, r, f), strict=True):
        assert one(spark, T.rouge(*t, kind, mode), a=a, b=b) == pytest.approx(want)
        if kind == "l":
            assert one(spark, T.rouge(*t, kind, mode, T.lcs_length), a=a, b=b) == pytest.approx(want)


def test_bleu_chrf_and_edges(spark):
    t = (T.ws_tokens(F.col("a")), T.ws_tokens(F.col("b")))
    assert one(spark, T.bleu_unigram(*t), a="the cat sat", b="the cat slept") == pytest.approx(2 / 3)
    assert one(spark, T.rouge_l_recall(*t), a="the cat sat", b="the cat slept") == pytest.approx(2 / 3)
    assert [one(spark, T.bleu(*t), a=a, b=b) for a, b in (("", ""), ("hello world", ""), ("a b", "a b"))] == [1.0, 0.0, 0.0]
    assert one(spark, T.bleu(*t), a="a b c d e", b="a b c d e") == pytest.approx(1.0)
    assert one(spark, T.chrf_unigram(F.col("a"), F.col("b")), a="abc", b="abd") == pytest.approx(2 / 3)
    assert [one(spark, T.chrf(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("", ""), ("a", ""), ("same text", "same text"))] == [1.0, 0.0, 1.0]
    assert one(spark, T.ws_tokens(F.col("a")), a="(Hello), WORLD Éère -- 3.5!") == ["hello", "world", "re", "3.5"]


def test_text_helpers(spark):
    assert one(spark, T.sentences(F.col("a")), a="One. Two! 3.5 tail") == ["One.", "Two!", "3.", "5 tail"]
    assert one(spark, T.claims(F.col("a")), a="a; b. ?c") == ["a", "b", "c"]
    assert one(spark, T.headings(F.col("a")), a="# A\ntext\n### B c\n#no\n####### too") == ["A", "B c"]
    assert one(spark, T.normalize_sql(F.col("a")), a=" SELECT  1 ;; ") == "select 1"
    assert one(spark, T.squeeze_sql(F.col("a")), a=" SELECT  1 ;; ") == "select1"
    s = one(spark, T.quoted_spans(F.col("a")), a='é "日本" x "b')
    assert [(x["text"], x["char_start"], x["char_end"], x["byte_start"], x["byte_end"]) for x in s] == [("日本", 3, 5, 4, 10)]
    assert [one(spark, T.binary_verdict(F.col("a")), a=x) for x in ("Yes", "0", "2", "false", "maybe")] == [1.0, 0.0, 1.0, 0.0, None]
    assert one(spark, T.redact_map(F.col("m")), m={"api_key": "x", "q": "sk-1", "z": "ok"}) == {"api_key": "[REDACTED]", "q": "[REDACTED]", "z": "ok"}
    m = [Row(role="User", content="hi", tool_call_id=None, tool_calls=[]), Row(role="Assistant", content="", tool_call_id=None, tool_calls=[Row(id="1", name="f", arguments="{}")]), Row(role="System", content="s", tool_call_id=None, tool_calls=[])]
    df = spark.createDataFrame([(m,)], datasets.MULTI_TURN.split(", reference_tool_calls")[0])
    assert df.select(T.transcript(F.col("messages"))).first()[0] == "Human: hi\nTools:\n  f: {}"
    assert df.select(M.call_keys(M.tool_calls(F.col("messages")))).first()[0] == ["f\u0001{}"]


def test_scores(spark):
    assert one(spark, V.average_precision(F.col("v")), v=[1, 0, 1, 1]) == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    assert one(spark, M.id_precision(F.col("a"), F.col("b")), a=["a", "b", "c"], b=["b", "c", "z"]) == pytest.approx(2 / 3)
    assert one(spark, M.id_recall(F.col("a"), F.col("b")), a=["c1", "c2", "c3"], b=["c1", "c2"]) == 1.0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.5, 0.5]) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, V.f1(F.col("a"), F.lit(1), F.lit(2)), a=3) == pytest.approx(6 / 9)
    assert one(spark, V.answer_correctness(F.col("a"), V.f1(F.lit(2), F.lit(1), F.lit(1))), a=0.8) == pytest.approx(0.7)
    t = M.csv_rows(F.col("a")), M.csv_rows(F.col("b"))
    assert one(spark, M.table_overlap(*t, "precision"), a='1,a\n2,b\n3,"c,d"\n4,e', b='1,a\n2,b\n3,"c,d"') == pytest.approx(0.75)
    assert one(spark, M.tool_call_accuracy(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "x"]) == 0.0
    assert one(spark, M.tool_call_accuracy(F.col("a"), F.col("b"), False), a=["x", "y"], b=["y", "x"]) == 1.0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, small)
    rel = c.sql(catalog.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    norm = lambda v: round(v, 5) if isinstance(v, float) else list(v) if isinstance(v, list | tuple) else v
    got = sorted(repr([norm(r[k]) for k in order]) for r in df.collect())
    want = sorted(repr([norm(dict(zip(rel.columns, r, strict=True))[k]) for k in order]) for r in rel.fetchall())
    assert got == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_jsonl_samples_score_by_recall(spark, tmp_path):
    line = '{"sample_type":"single_turn","user_input":"q","response":"%s","retrieved_contexts":["c"],"metadata":{}%s}'
    (tmp_path / "a.jsonl").write_text("\n".join([line % ("the cat sat", ',"reference":"the cat slept"'), line % ("a b", ',"reference":"a b"'), line % ("no reference", "")]) + "\n")
    d = datasets.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    r = A.report(evaluate.evaluate(datasets.single_turn(d), ["rouge_l"])).first()
    assert (r["count"], r["errors"]) == (2, 1) and r["mean"] == pytest.approx((2 / 3 + 1) / 2)
    assert "rouge_l" in evaluate.report_lines([r])


def test_sources_round_trip(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('question,response,retrieved_contexts,reference,metadata.k\nq1, r1 ,a | b||c,,v\n"q,2",r2,"[""x"", ""y|z""]",ref,\n')
    d = datasets.read_csv(spark, str(p), {"user_input": "question"})
    rows = sorted(d.collect(), key=lambda r: r["sample_index"])
    assert [r["retrieved_contexts"] for r in rows] == [["a", "b", "c"], ["x", "y|z"]] and rows[0]["metadata"] == {"k": "v"} and rows[0]["reference"] is None
    datasets.write_jsonl(d, str(tmp_path / "j"))
    back = datasets.read_jsonl(spark, str(tmp_path / "j"))
    assert sorted(r["user_input"] for r in back.collect()) == ["q,2", "q1"]
    datasets.write_csv(d, str(tmp_path / "c"))
    assert datasets.read_csv(spark, str(tmp_path / "c")).count() == 2
    files = datasets.FileBackend(spark, str(tmp_path / "backend"))
    files.save("one", d)
    assert files.list() == ["one"] and files.load("one").count() == 2 and files.delete("one") and files.list() == []
    with pytest.raises(datasets.DatasetError):
        files.load("none")
    views = datasets.ViewBackend(spark)
    views.save("v1", d)
    assert views.list() == ["v1"] and views.delete("v1") and not views.delete("v1")
    with pytest.raises(datasets.DatasetError):
        datasets.validated(d.withColumn("response", F.lit(" ")))
    assert datasets.validated(d).count() == 2


SAMPLES = [(1, "q one", "Alpha is here. Beta too.", ["Alpha is here"], "Alpha is here."), (2, "q two", "", [], None)]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLES, "sample_index long, user_input string, response string, retrieved_contexts array<string>, reference string")


def test_judges(spark, samples):
    keep = lambda df: df.cache()
    got = {r["sample_index"]: r for r in judges.faithfulness(samples, providers.Scripted(providers.rule_judge), keep).collect()}
    assert got[1]["value"] == 0.5 and math.isnan(got[2]["value"])
    yes = providers.Scripted(lambda p: '```json\n{"verdict": 1, "rating": 3, "TP": ["a"], "FP": ["b"], "FN": [], "score": 4.5, "classifications": [{"verdict": 1}], "entities": ["Alpha"], "questions": ["x"], "answers": [{"verdict": 1}]}\n```')
    value = lambda df: {r["sample_index"]: r["value"] for r in df.collect()}
    assert value(judges.context_verdicts(samples, yes, keep)) == {1: 1.0, 2: None}
    assert value(judges.context_recall(samples, yes, keep)) == {1: 1.0, 2: None}
    assert value(judges.context_relevance(samples, yes, keep)) == {1: 0.75, 2: 0.0}
    assert value(judges.factual_correctness(samples, yes, keep))[1] == pytest.approx(2 / 3)
    assert value(judges.aspect_critic(samples, yes, keep, "kind", 3)) == {1: 1.0, 2: 1.0}
    assert value(judges.rubric_score(samples, yes, keep, "1 to 5")) == {1: 4.5, 2: 4.5}
    assert value(judges.entity_recall(samples, yes, keep)) == {1: 1.0, 2: None}
    assert value(judges.summarization_score(samples, yes, keep)) == {1: 1.0, 2: None}
    assert value(judges.sql_semantic_equivalence(samples, yes, keep))[1] == 1.0
    bad = value(judges.context_recall(samples, providers.Scripted(lambda p: "no json"), keep))
    assert bad == {1: None, 2: None}
    assert value(judges.semantic_similarity(samples, providers.HashEmbedding(), keep))[1] > 0.5


def test_provider_stage_caches_and_retries(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("gone")
        return ["ok"]

    assert providers.with_retries(flaky, providers.RunConfig(attempts=3), sleep=lambda s: None) == ["ok"] and len(calls) == 3
    with pytest.raises(providers.NotFinished):
        providers.with_retries(lambda: (_ for _ in ()).throw(providers.NotFinished("x")), providers.RunConfig())
    r = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "request string")
    cache = spark.createDataFrame([("a", "cached", None)], "request string, answer string, error string")
    got = {x["request"]: x["answer"] for x in providers.call_stage(r, providers.Scripted(str.upper), lambda d: d.cache(), cache).collect()}
    assert got == {"a": "cached", "b": "B"}
    assert providers.json_block('text ```json\n{"a": [1]} ``` tail') == '{"a": [1]}' and providers.json_block(" none ") == "none"
    with pytest.raises(providers.NotFinished):
        providers.parse_chat({"choices": [{"finish_reason": "length", "message": {"content": "x"}}]})
    assert providers.parse_embeddings({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}) == [[1.0], [2.0]]


def test_chunks_are_given_back_in_small_batches():
    texts = ["word " * 700, None, " ", "x" * 5000, *["a bb ccc " * 400] * 500, "last one"]
    batches = [pa.RecordBatch.from_pydict({"k": list(range(i, i + len(t))), "t": t}) for i, t in ((0, texts[:300]), (300, texts[300:]), (len(texts), []))]
    got = list(chunking.cut_documents(iter(batches), 100, held_bytes=20_000))
    assert max(sum(len(t) for t in b["text"].to_pylist()) for b in got) < 20_000 + 5000 and len(got) > 80
    want = [(f"{k}-chunk-{i}", str(k), i, c) for k, t in enumerate(texts) for i, c in enumerate(chunking.pack_words(t or "", 100))]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


def test_graph_and_testset(spark):
    assert chunking.pack_words("aa bb cc dddddd", 5) == ["aa bb", "cc", "dddddd"] and chunking.pack_words(" ", 5) == []
    assert chunking.split_at_headlines("intro A one B two", ["A", "B"]) == ["intro", "A one", "B two"]
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five")], "doc_id long, text string")
    n, e = testset.document_graph(docs, 10)
    assert n.count() == 5 and e.where("relationship = 'next'").count() == 1 and e.where("relationship = 'contains'").count() == 3
    assert testset.template_samples(n, e).groupBy("hop_count").count().orderBy("hop_count").collect() == [Row(hop_count=1, count=3), Row(hop_count=2, count=1)]
    themes = spark.createDataFrame([(0, "n1", 0, "Cats"), (0, "n1", 1, "dogs"), (1, "n2", 0, "birds"), (1, "n2", 1, "none")], "node_ord int, node_id string, term_ord int, term string")
    personas = spark.createDataFrame([(0, "P", "cats"), (1, "Q", "CATS"), (0, "P", "birds"), (1, "Q", "dogs")], "ord int, name string, term string")
    got = testset.single_hop_scenarios(themes, personas, 4).orderBy("i").collect()
    assert [(r["node_id"], r["term"], r["persona"], r["style"], r["length"]) for r in got] == [("n1", "Cats", "P", "misspelled", "short"), ("n1", "dogs", "Q", "perfect_grammar", "medium"), ("n2", "birds", "P", "poor_grammar", "long")]
    assert testset.splits(5, [1 / 3, 1 / 3, 1 / 3]) == [2, 2, 1]
    v = testset.with_property(n, n.select("id", F.array(F.lit("x")).alias("value")), "themes")
    assert v.where("props['themes'] = '[\"x\"]'").count() == 5


def test_optimizer_and_prompts():
    assert optimize.render("a {{x}} {{ y }}", {"x": 1, "y": True}) == "a 1 true"
    with pytest.raises(optimize.PromptError):
        optimize.render("{{x}}", {})
    assert optimize.fnv1a(b"") == "cbf29ce484222325" and optimize.fnv1a(b"a") == "af63dc4c8601ec8c"
    assert optimize.cache_key("f", {"a": 1, "callbacks": 2}) == optimize.cache_key("f", {"a": 1})
    run = lambda: optimize.Genetic(generations=2)
    grow = lambda p, s: p + " x"
    a, b = run(), run()
    assert a.run(["go"], lambda ps: [float(len(p)) for p in ps], grow) == b.run(["go"], lambda ps: [float(len(p)) for p in ps], grow) and a.history == b.history and len(a.history) == 12


def test_streaming_report(spark, tmp_path):
    from assayer.streaming.scores import windowed_report

    spark.createDataFrame([("2024-01-01 00:01:00", "m", 1.0), ("2024-01-01 00:02:00", "m", float("nan")), ("2024-01-01 01:00:00", "m", 0.5)], "t string, metric_name string, value double").write.json(str(tmp_path / "in"))
    s = spark.readStream.schema("t string, metric_name string, value double").json(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("t"))
    q = windowed_report(s).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["count"], r["errors"]) for r in spark.table("win").orderBy("start").collect()] == [(1, 1), (1, 0)]


def test_noise_sensitivity_and_topics(spark, samples):
    keep = lambda df: df.cache()
    value = lambda df: {r["sample_index"]: r["value"] for r in df.collect()}

    def judge(p):
        if p.startswith("statements of"):
            return '{"statements": ["a", "b"]}'
        if p.startswith("attribute"):
            return '{"verdicts": [{"verdict": 1}]}'
        return '{"verdicts": [{"verdict": 0}, {"verdict": 1}]}' if p.endswith("Alpha is here.") else '{"verdicts": [{"verdict": 1}, {"verdict": 1}]}'

    assert value(judges.noise_sensitivity(samples, providers.Scripted(judge), keep)) == {1: 0.5, 2: None}
    assert value(judges.noise_sensitivity(samples, providers.Scripted(judge), keep, relevant=False)) == {1: 0.0, 2: None}
    assert value(judges.noise_sensitivity(samples, providers.Scripted(lambda p: '{"statements": ["a"], "verdicts": []}'), keep)) == {1: None, 2: None}
    talk = "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>"
    d = spark.createDataFrame([(1, ["x"]), (2, [])], "sample_index long, reference_topics array<string>").withColumn("messages", F.from_json(F.lit('[{"role":"user","content":"hi"}]'), talk))

    def topics(p):
        if p.startswith("topics"):
            return '{"topics": ["x", "y", "z"]}'
        return '{"refused_to_answer": false}' if p.startswith("refused? x") or p.startswith("refused? y") else '{"refused_to_answer": true, "classifications": [true, false]}'

    got = value(judges.topic_adherence_score(d, providers.Scripted(topics), keep, "precision"))
    assert got[1] == pytest.approx(0.5) and got[2] is None


def test_scenarios(spark):
    keep = lambda df: df.cache()
    v = spark.createDataFrame([(0, "s", [1.0, 0.0]), (1, "longer", [0.9, 0.1]), (2, "other", [0.0, 1.0])], "ord int, summary string, vector array<double>")
    assert testset.representatives(v, 3, keep) == ["longer", "other"]
    who = testset.personas(v, 2, providers.Scripted(lambda p: '{"name": "N %s", "role_description": "r"}' % p[-5:]), keep)
    assert [(r["ord"], r["name"]) for r in who.orderBy("ord").collect()] == [(0, "N onger"), (1, "N other")]
    with pytest.raises(providers.ProviderError):
        testset.personas(v, 1, providers.Scripted(lambda p: '{"name": " "}'), keep)
    people = spark.createDataFrame([(0, "P", "r"), (1, "Q", "r")], "ord int, name string, role string")
    edges = spark.createDataFrame([(0, "b", "a", ["Cat => cat", "Dog => dog"]), (1, "a", "b", ["Bird => bird"]), (2, "c", "c", ["x => x"])], "ord int, source_id string, target_id string, overlapped array<string>")
    entities = spark.createDataFrame([("a", "CAT"), ("b", "cat"), ("b", "dog")], "id string, item string")
    maps = providers.Scripted(lambda p: '{"mapping": {"Q": ["cat", "DOG"], "P": ["Cat"]}}')
    got = testset.multi_hop_specific(edges, entities, people, 2, maps, keep).orderBy("i").collect()
    assert [(r["node_ids"], r["combination"], r["persona"], r["style"]) for r in got] == [(["a", "b"], ["Cat"], "P", "misspelled"), (["a", "b"], ["cat"], "P", "perfect_grammar")]
    clusters = spark.createDataFrame([(0, ["a", "b"])], "ord int, nodes array<string>")
    child = spark.createDataFrame([(0, "b", "k", "child")], "ord int, source_id string, target_id string, relationship string")
    themes = spark.createDataFrame([("a", ["cat"]), ("k", ["dog"])], "id string, themes array<string>")
    both = providers.Scripted(lambda p: '{"combinations": [[], ["Cat", "dog"], ["fish"]]}' if p.startswith("at most") else '{"mapping": {"Q": ["dog"]}}')
    got = testset.multi_hop_abstract(clusters, child, themes, people, 3, both, keep)
    assert [(r["node_ids"], r["combination"], r["persona"]) for r in got.collect()] == [(["a", "k"], ["Cat", "dog"], "Q")]
    nodes = spark.createDataFrame([(0, "d", "document", {"summary": "s"}), (1, "a", "chunk", {"text": "one"}), (2, "k", "chunk", {"text": "two"})], "ord int, id string, node_type string, props map<string,string>")
    told = testset.scenario_samples(got, nodes, people, providers.Scripted(lambda p: '{"query": "q", "answer": "%d"}' % p.count("-hop>")), keep, "multi_hop_abstract").collect()
    assert [(r["reference"], r["reference_contexts"]) for r in told] == [("2", ["<1-hop>\n\none", "<2-hop>\n\ntwo"])]
    links = spark.createDataFrame([(0, "d", "a", "contains"), (1, "d", "k", "contains"), (2, "a", "k", "next")], "ord int, source_id string, target_id string, relationship string")
    n, e = testset.filter_chunks(nodes, links, providers.Scripted(lambda p: '{"score": 2.4}' if p.endswith("two") else '{"score": 3}'), keep)
    assert sorted(r["id"] for r in n.collect()) == ["a", "d"] and [r["ord"] for r in e.collect()] == [0]
