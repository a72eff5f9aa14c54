"""Run control, providers, sources and the command line."""

import json
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.__main__ import column_map, main
from assayer.functions import text as T
from assayer.operators import aggregates as A
from assayer.plans import evaluate as E
from assayer.plans import optimize as O
from assayer.plans import providers as P
from assayer.sources import datasets as D


@pytest.fixture
def keep(tmp_path):
    return P.stored(f"file://{tmp_path}/kept")


def test_a_stage_holds_few_requests_at_a_time(spark, keep):
    begun = []

    def one(asked):
        begun.append(len(asked))
        return pd.DataFrame({"request": asked})

    config = P.RunConfig(concurrency=2, batch=5)
    batches = [pa.RecordBatch.from_pydict({"request": [f"{b}-{i}" for i in range(1003)]}) for b in range(2)]
    stream = P.in_flight(one, iter(batches), config)
    first = next(stream)
    assert len(begun) <= 4 * config.concurrency
    rest = [r for pdf in stream for r in pdf["request"]]
    assert sorted([*first["request"], *rest]) == sorted(r for b in batches for r in b["request"].to_pylist()) and max(begun) == 5
    asked = spark.range(5000).select(F.concat(F.lit("q"), "id").alias("request"))
    told = P.call_stage(asked, P.Scripted(lambda p: p.upper()), keep, config=config)
    assert told.where("answer = upper(request) and error is null").distinct().count() == told.count() == 5000


def test_retries_time_out_and_stop(spark):
    quick = P.RunConfig(attempts=2, first_wait=1, most_wait=1, timeout=50)
    calls = []

    def slow():
        calls.append(1)
        time.sleep(0.3)

    with pytest.raises(TimeoutError):
        P.with_retries(slow, quick)
    assert len(calls) == 2

    def unfinished():
        calls.append(1)
        raise P.NotFinished("length")

    with pytest.raises(P.NotFinished):
        P.with_retries(unfinished, quick)
    assert len(calls) == 3


class Metered:
    def generate(self, prompts):
        raise AssertionError("the metered call is used")

    def generate_metered(self, prompts):
        if any("bad" in p for p in prompts):
            raise P.ProviderError("no")
        return [(p.upper(), len(p), 1) for p in prompts]


def test_stages_meter_and_raise(spark, keep):
    df = spark.createDataFrame([("a",), ("bb",), ("a",)], "request string")
    one = P.RunConfig(attempts=1, batch=1, concurrency=3)
    stage = P.call_stage(df, Metered(), keep, config=one)
    assert {(r["request"], r["answer"]) for r in stage.collect()} == {("a", "A"), ("bb", "BB")}
    used = A.usage(P.usage_rows(stage, "p", "m")).where("level = 3").first()
    assert (used["prompt_tokens"], used["completion_tokens"], used["total_tokens"]) == (3, 2, 5)
    bad = df.unionByName(spark.createDataFrame([("bad",)], "request string"))
    assert P.call_stage(bad, Metered(), keep, config=one).where("error is not null").count() == 1
    with pytest.raises(P.ProviderError):
        P.call_stage(bad, Metered(), keep, config=P.RunConfig(attempts=1, batch=1, raise_errors=True))
    short = P.call_stage(df, P.Scripted(lambda p: p), keep, cache=stage.where("request = 'a'"), config=one)
    assert {(r["request"], r["answer"]) for r in short.collect()} == {("a", "A"), ("bb", "bb")}
    unit = P.Normalized(P.HashEmbedding(8)).embed(["some text", ""])
    assert sum(x * x for x in unit[0]) == pytest.approx(1) and unit[1] == [0.0] * 8


def test_registry_configuration_requests(tmp_path):
    r = P.Registry()
    r.register("x", 1)
    assert r.get("x") == 1 and r.names() == ["x"]
    with pytest.raises(P.ProviderError):
        r.get("y")
    (tmp_path / ".env").write_text("# c\nASSAYER_MODEL='m'\nexport ASSAYER_ATTEMPTS=3\nASSAYER_API_KEY=k\n")
    c = P.ProviderConfig.load({"ASSAYER_MODEL": "n"}, str(tmp_path / ".env"))
    assert (c.model, c.attempts, c.api_key, c.timeout_ms) == ("n", 3, "k", 180_000) and c.shown()["api_key"] == "***"
    q = P.HttpProvider("http://h/v1/", "m", "key", key_header="api-key", query={"api-version": "1"}).request("/chat", {})
    assert q.full_url == "http://h/v1/chat?api-version=1" and q.get_header("Api-key") == "key" and not q.has_header("Authorization")
    assert P.HttpProvider("http://h", "m", "key").request("/x", {}).get_header("Authorization") == "Bearer key"
    assert P.safe_body("key Bearer abc.def " + "x" * 3000, "key").startswith("*** Bearer *** x") and len(P.safe_body("x" * 3000)) == 2051


def test_provider_benchmark(spark):
    got = {(r["provider"], r["prompt"]): (r["units"], r["error"] is None) for r in P.benchmark(spark, {"say": P.Scripted(lambda p: p + "é"), "vec": P.HashEmbedding(4), "no": P.Scripted(lambda p: 1 / 0)}, ["a", "bc"]).collect()}
    assert got == {("say", "a"): (3, True), ("say", "bc"): (4, True), ("vec", "a"): (4, True), ("vec", "bc"): (4, True), ("no", "a"): (0, False), ("no", "bc"): (0, False)}


def test_fail_fast_order_observers(spark):
    s = spark.createDataFrame([(2, 0, "m", 1.0, None), (1, 1, "n", None, "second"), (1, 0, "m", None, "first"), (0, 0, "m", 0.5, None)], "sample_index long, metric_index int, metric_name string, value double, error string")
    with pytest.raises(E.MetricFailed, match="sample 1, metric m: first"):
        E.fail_fast(s)
    assert E.fail_fast(s.where("error is null")).count() == 2
    assert [(r["sample_index"], r["metric_index"]) for r in E.ordered(s).collect()] == [(0, 0), (1, 0), (1, 1), (2, 0)]
    told = []
    E.notify(s, [lambda e: 1 / 0, lambda e: told.append((e["sample_index"], e["metric_index"], e["kind"]))])
    assert told[:4] == [(0, 0, "metric_started"), (0, 0, "metric_succeeded"), (1, 0, "metric_started"), (1, 0, "metric_failed")]
    with pytest.raises(KeyError):
        E.resolve("nothing")
    assert E.names() == sorted(E.NATIVE)


def test_tasks_in_order():
    seen = []
    slow = lambda x, t: lambda: (time.sleep(t), x)[1]
    assert E.in_order([slow(1, 0.05), slow(2, 0)], 2, lambda d, n: seen.append((d, n))) == [1, 2] and seen == [(1, 2), (2, 2)]
    out = E.in_order([lambda: 1 / 0, slow(3, 0)])
    assert isinstance(out[0], ZeroDivisionError) and out[1] == 3
    with pytest.raises(ZeroDivisionError):
        E.in_order([lambda: 1 / 0], raise_errors=True)


def test_prompts():
    assert O.render("{{a}} {{ b }}", {"a": "x", "b": 2.5}, kinds={"a": "text", "b": "number"}) == "x 2.5"
    for template, values, kinds in (("{{a}}", {}, {"a": "text"}), ("{{a}}", {"a": True}, {"a": "number"}), ("{{a b}}", {}, {})):
        with pytest.raises(O.PromptError):
            O.render(template, values, kinds=kinds)
    assert O.differences({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == ["b: 2 is not 3", "c: None is not 4"]
    plan = O.trial_plan(3, 2, 5)
    assert plan == O.trial_plan(3, 2, 5) and all(i < 3 and j < 2 for _, i, j in plan)


def test_costs_and_runs(spark):
    calls = spark.createDataFrame([("m", 10, 20), ("n", 1, 1)], "model string, prompt_tokens long, completion_tokens long")
    rates = spark.createDataFrame([("m", 0.1, 0.2), ("n", 1.0, None)], "model string, input_rate double, output_rate double")
    assert A.total_model_cost(calls, rates) == pytest.approx(7.0) and A.estimated_cost(calls, 0.1).first()["cost"] == pytest.approx(3.2)
    with pytest.raises(ValueError, match="no rate for model n"):
        A.total_model_cost(calls, rates.where("model = 'm'"))
    a = spark.createDataFrame([(1,), (2,)], "sample_index long")
    assert A.sample_count_delta(a, a.where("sample_index = 1")) == -1


def test_jaro_many_equals_jaro():
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(0, 9)))
    x, y = [word() for _ in range(3000)], [word() for _ in range(3000)]
    assert T.jaro_many(x, y, cells=500).tolist() == pytest.approx([T.jaro(p, q) for p, q in zip(x, y, strict=True)])
    assert T.jaro_many(x, y, True).tolist() == pytest.approx([T.jaro_winkler(p, q) for p, q in zip(x, y, strict=True)])
    assert T.jaro_many([], []).tolist() == []


def test_similar_items_lose_no_match(spark):
    import random

    from assayer.operators.graph import similar_items

    rng = random.Random(2)
    items = sorted({"".join(rng.choice("abcdet") for _ in range(rng.randint(1, 8))) for _ in range(250)} | {""})
    df = spark.createDataFrame([(i,) for i in items], "low string")
    for at in (0.7, 0.85, 0.9):
        got = {(r["x"], r["y"]) for r in similar_items(df, at).collect()}
        assert got == {(a, b) for a in items for b in items if T.jaro_winkler(a, b) >= at}


def test_sources_tell_where_they_fail(spark, tmp_path):
    good = '{"sample_type": "single_turn", "user_input": "q", "response": "a", "retrieved_contexts": ["c"]}'
    (tmp_path / "a.jsonl").write_text(good + "\n\n" + good + "\nbroken\n")
    with pytest.raises(D.DatasetError, match="line 4"):
        D.checked_jsonl(spark, str(tmp_path / "a.jsonl"))
    (tmp_path / "b.jsonl").write_text(good + "\n\n" + good + "\n")
    assert D.checked_jsonl(spark, str(tmp_path / "b.jsonl")).count() == 2
    (tmp_path / "c.csv").write_text("user_input,response,retrieved_contexts\nq,a,c\nq, ,c\n")
    with pytest.raises(D.DatasetError, match="row 3: response"):
        D.checked_csv(spark, str(tmp_path / "c.csv"))


def test_builder_sheets_cache_graphs(spark, tmp_path):
    df, known = D.DatasetBuilder(spark).add_single_turn("q", "a", ["c", "d"], note="x").add_multi_turn([("User", "hi")]).with_metadata("k", "v").build()
    assert [r["sample_type"] for r in df.orderBy("sample_index").collect()] == ["single_turn", "multi_turn"] and known == {"k": "v"}
    with pytest.raises(D.DatasetError):
        D.DatasetBuilder(spark).build()
    sheets = D.MemorySheets()
    b = D.SheetBackend(spark, sheets, D.SheetConfig("team", "secret"))
    b.save("one", df)
    assert sheets.names() == ["team/one.gsheet"] and b.list() == ["one"] and sheets.read("team/one.gsheet")[0] == sorted(c for c in df.columns if c != "sample_index")
    back = b.load("one").orderBy("sample_index").collect()
    assert back[0]["retrieved_contexts"] == ["c", "d"] and back[0]["metadata"] == {"note": "x"} and back[1]["messages"][0]["content"] == "hi" and back[1]["response"] is None
    assert b.delete("one") and not b.delete("one") and b.config.shown()["credentials"] == "***"
    with pytest.raises(D.DatasetError):
        b.load("one")
    with pytest.raises(D.DatasetError):
        D.SheetBackend(spark, sheets, D.SheetConfig("t"), most_rows=1).save("x", df)
    c = D.DiskCache(str(tmp_path / "cache"))
    c.set("a/b", b"\x00x")
    assert c.get("a/b") == b"\x00x" and c.has_key("a/b") and c.keys() == ["a/b"] and c.get("z") is None and c.delete("a/b") and not c.delete("a/b")
    nodes = spark.createDataFrame([(0, "a", "document", {"text": "t"})], "ord long, id string, node_type string, props map<string,string>")
    edges = spark.createDataFrame([(0, "a", "b", "next", {"order": "1"})], "ord long, source_id string, target_id string, relationship string, props map<string,string>")
    D.write_graph(nodes, edges, str(tmp_path / "graph"))
    n, e = D.read_graph(spark, str(tmp_path / "graph"))
    assert n.collect() == nodes.collect() and e.collect() == edges.collect()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("ASSAYER_API_KEY", raising=False)
    good = '{"sample_type": "single_turn", "user_input": "q", "response": "%s", "retrieved_contexts": ["c"], "reference": "the cat sat"}'
    (tmp_path / "s.jsonl").write_text(good % "the cat sat" + "\n" + good % "a dog" + "\n")
    assert main(["evaluate", str(tmp_path / "s.jsonl"), "--metrics", "exact_match,rouge_l", "--report", str(tmp_path / "r.json")]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["metrics"]["exact_match"] == {"count": 2, "errors": 0, "mean": 0.5, "std": 0.5}
    assert [m["metric_name"] for m in json.loads((tmp_path / "r.json").read_text())["metrics"]] == ["exact_match", "rouge_l"]
    assert main(["evaluate", str(tmp_path / "none.jsonl")]) == 1 and "error" in json.loads(capsys.readouterr().err)
    assert main(["nothing"]) == 2
    (tmp_path / "doc.txt").write_text("one two three " * 40)
    assert main(["testset", str(tmp_path / "doc.txt"), "--output", str(tmp_path / "out"), "--env", str(tmp_path / "no.env")]) == 0
    capsys.readouterr()
    assert main(["config", "--env", str(tmp_path / "no.env")]) == 0 and "base_url" in json.loads(capsys.readouterr().out)
    assert main(["benchmark", str(tmp_path / "s.jsonl")]) == 0 and json.loads(capsys.readouterr().out)["samples"] == 2
    assert column_map("a=b, c=d") == {"a": "b", "c": "d"} and F is not None
    with pytest.raises(D.DatasetError):
        column_map("a")
