"""Test sets from documents: graph transforms, scenarios and samples."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from assayer.functions.text import ascii_lower, is_blank, overlap_themes, text_list, utrim
from assayer.functions.vector import cosine
from assayer.operators.aggregates import frequent_items
from assayer.operators.chunking import chunk_documents, pack_words
from assayer.operators.graph import contains_edges, cosine_pairs, entity_overlap, parent_summary, without
from assayer.plans.judges import ask
from assayer.plans.providers import ProviderError, call_stage

STYLES = ["misspelled", "perfect_grammar", "poor_grammar", "web_search"]
LENGTHS = ["short", "medium", "long"]
# Property and JSON key of each extractor; list kinds keep every item.
EXTRACTORS = {"summary": ("text", False), "keyphrases": ("keyphrases", True), "title": ("text", False), "headlines": ("headlines", True), "entities": ("entities", True), "themes": ("output", True), "topic_description": ("description", False)}


@F.pandas_udf(ArrayType(StringType()))
def _pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [t] if t.strip() and len(t.encode()) <= 32_000 else pack_words(t, 32_000))


def extract(nodes: DataFrame, kind: str, provider, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, value) for one extractor, asked of texts in pieces of up to 32,000 bytes: single values come
    from the first piece, lists from all. A blank text has an empty value and no call; a failed call
    fails the stage."""
    key, many = EXTRACTORS[kind]
    pieces = nodes.select("id", F.posexplode_outer(_pieces(F.coalesce(F.col("props")["text"], F.lit("")))).alias("k", "piece"))
    pieces = pieces if many else pieces.where("k is null or k = 0")
    told = keep(ask(pieces, provider, keep, F.concat(F.lit(f"extract {kind}: "), "piece"), F.col("piece").isNotNull(), f"{key} {'array<string>' if many else 'string'}"))
    told = _sound(told)
    v = F.col("got")[key]
    if not many:
        return told.select("id", F.coalesce(v, F.lit("")).alias("value"))
    rows = told.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce(v, F.array().cast("array<string>")).alias("v")))).alias("s"))
    return rows.select("id", F.flatten(F.transform("s", lambda x: x["v"])).alias("value"))


def extract_bundle(nodes: DataFrame, provider, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, entities, themes, summary) of each node."""
    parts = [extract(nodes, k, provider, keep).withColumnRenamed("value", k) for k in ("entities", "themes", "summary")]
    return parts[0].join(parts[1], "id").join(parts[2], "id")


def parse_bundle(answers: DataFrame) -> DataFrame:
    """A bundle (entities, themes, summary) per row of (id, answer); what is no such JSON is an error."""
    got = answers.select("id", F.from_json("answer", "entities array<string>, themes array<string>, summary string").alias("g"), F.try_parse_json("answer").alias("j"))
    bad = got.where("j is null or g.summary is null or g.entities is null or g.themes is null").first()
    if bad:
        raise ProviderError(f"parse error: node {bad['id']} has no bundle of entities, themes and summary")
    return got.select("id", "g.*")


def attach_extractions(nodes: DataFrame, bundles: DataFrame) -> DataFrame:
    """Writes bundles into props, lists trimmed, without blanks, sorted and each value once."""
    for name in ("entities", "themes"):
        nodes = with_property(nodes, bundles.select("id", text_list(F.col(name)).alias("value")), name)
    return with_property(nodes, bundles.select("id", utrim(F.col("summary")).alias("value")), "summary")


def embed(nodes: DataFrame, provider, keep: Callable[[DataFrame], DataFrame], source: str = "text", name: str = "embedding") -> DataFrame:
    """Nodes with the vector of one of their properties in props, as JSON; a node without that property
    is an error."""
    lacking = nodes.where(F.col("props")[source].isNull()).first()
    if lacking:
        raise ValueError(f"node {lacking['id']} has no property {source}")
    asked = nodes.select("id", F.col("props")[source].alias("request"))
    got = call_stage(asked, provider, keep)
    bad = got.where("error is not null").first()
    if bad:
        raise ProviderError(bad["error"])
    return with_property(nodes, asked.join(got, "request").select("id", F.col("vector").alias("value")), name)


def with_property(nodes: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Writes value (as JSON for lists) into props."""
    kind = values.schema["value"].dataType.typeName()
    v = F.to_json("value") if kind == "array" else F.col("value")
    joined = nodes.join(values.select("id", v.alias("_v")), "id", "left")
    fresh = F.map_concat(F.map_filter("props", lambda k, _: k != name), F.create_map(F.lit(name), F.col("_v")))
    return joined.withColumn("props", F.when(F.col("_v").isNotNull(), fresh).otherwise(F.col("props"))).drop("_v")


def _sound(df: DataFrame) -> DataFrame:
    """Raises the first error of a stage."""
    bad = df.where("failed is not null").select("failed").first()
    if bad:
        raise ProviderError(bad["failed"])
    return df.drop("failed")


def filter_chunks(nodes: DataFrame, edges: DataFrame, provider, keep: Callable[[DataFrame], DataFrame], least: int = 2) -> tuple[DataFrame, DataFrame]:
    """The graph without chunks whose content scores at most ``least`` of 5 against the summary of
    their document. Chunks without such a summary stay and are not asked for."""
    known = parent_summary(nodes, edges).where("node_type = 'chunk'")
    prompt = F.concat(F.lit("score 1 to 5 by summary: "), "parent_summary", F.lit("\ncontent: "), F.coalesce(F.col("props")["text"], F.lit("")))
    scored = keep(ask(known, provider, keep, prompt, ~is_blank(F.col("parent_summary")), "score double"))
    gone = _sound(scored).where(F.round("got.score") <= least).select("id")
    return nodes.join(gone, "id", "left_anti"), without(edges, gone)


def document_graph(docs: DataFrame, most_bytes: int = 256) -> tuple[DataFrame, DataFrame]:
    """Nodes of documents and their chunks, and contains and next edges."""
    chunks = chunk_documents(docs, most_bytes)
    d = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("document").alias("node_type"), F.create_map(F.lit("text"), "text").alias("props"))
    c = chunks.select("id", F.lit("chunk").alias("node_type"), F.create_map(F.lit("text"), "text", F.lit("source_id"), "source_id").alias("props"))
    return d.unionByName(c), contains_edges(chunks)


def similarity_edges(vectors: DataFrame, threshold: float, score: str = "cosine_similarity") -> DataFrame:
    p = cosine_pairs(vectors, threshold)
    return p.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("cosine_similarity").alias("relationship"), F.create_map(F.lit(score), F.col("score").cast("string")).alias("props"))


def overlap_edges(items: DataFrame, at: float = 0.9, least: float = 0.01) -> DataFrame:
    """Edges between nodes whose entities match, the noisiest entities left out. items: (grp, item, position)."""
    noisy = frequent_items(items).select("item")
    return entity_overlap(items.join(noisy, "item", "left_anti"), at, least)


def single_hop_scenarios(themes: DataFrame, personas: DataFrame, n: int) -> DataFrame:
    """(node_id, term, persona, style, length): each theme goes to the first persona that names it, at
    most ceil(n / nodes) per node and n in all, styles and lengths in rotation.

    themes: (node_ord, node_id, term_ord, term); personas: (ord, name, term)."""
    p = personas.groupBy(ascii_lower(F.col("term")).alias("low")).agg(F.min_by("name", "ord").alias("persona"))
    hit = themes.withColumn("low", ascii_lower(F.col("term"))).join(p, "low")
    nodes = max(1, themes.select("node_id").distinct().count())
    per = F.row_number().over(Window.partitionBy("node_id").orderBy("term_ord"))
    few = hit.withColumn("_k", per).where(F.col("_k") <= ceil(n / nodes)).orderBy("node_ord", "term_ord").limit(n)
    i = F.row_number().over(Window.orderBy("node_ord", "term_ord")) - 1  # over at most n rows
    few = few.withColumn("i", i)
    style, length = (F.element_at(F.array(*map(F.lit, names)), (F.col("i") % len(names) + 1).cast("int")) for names in (STYLES, LENGTHS))
    return few.select("i", "node_id", "term", "persona", style.alias("style"), length.alias("length"))


def representatives(summaries: DataFrame, n: int, keep: Callable[[DataFrame], DataFrame], at: float = 0.75) -> list[str]:
    """Longest summaries, in bytes, of the first n greedy clusters of (ord, summary, vector).

    The first row left is an anchor and takes all rows whose cosine exceeds ``at``. Each of the n
    rounds is one distributed filter; one row a round reaches the driver."""
    left, out = summaries.where("summary is not null and vector is not null"), []
    for _ in range(n):
        anchor = left.orderBy("ord").first()
        if anchor is None:
            break
        near = (F.col("ord") == anchor["ord"]) | (cosine(F.col("vector"), F.lit([float(x) for x in anchor["vector"]])) > at)
        out.append(left.where(near).orderBy(F.octet_length("summary").desc(), "ord").first()["summary"])
        left = keep(left.where(~near))
    return out


def personas(summaries: DataFrame, n: int, provider, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ord, name, role): a persona for each of the first n clusters of summaries."""
    found = representatives(summaries, n, keep)
    if not found:
        raise ValueError("personas need nodes with a summary and its vector")
    reps = summaries.sparkSession.createDataFrame(list(enumerate(found)), "ord int, summary string")
    told = keep(ask(reps, provider, keep, F.concat(F.lit("persona for: "), "summary"), F.lit(True), "name string, role_description string"))
    name, role = F.trim("got.name"), F.trim("got.role_description")
    lacks = F.when(F.coalesce(name, F.lit("")) == "", "parse error: name is missing").when(F.coalesce(role, F.lit("")) == "", "parse error: role_description is missing")
    return _sound(told.select("ord", name.alias("name"), role.alias("role"), F.coalesce("failed", lacks).alias("failed")))


def match_themes(groups: DataFrame, personas: DataFrame, provider, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ord, low, persona): for each group (ord, themes) the first persona that the model gives each
    theme to, case aside. personas: (ord, name, role), few."""
    roster = personas.agg(F.to_json(F.sort_array(F.collect_list(F.struct("ord", "name", "role")))).alias("roster"))
    prompt = F.concat(F.lit("themes to personas: "), F.to_json("themes"), F.lit("\npersonas: "), "roster")
    told = _sound(keep(ask(groups.crossJoin(F.broadcast(roster)), provider, keep, prompt, F.size("themes") > 0, "mapping map<string,array<string>>")))
    flat = told.select(F.col("ord"), F.explode("got.mapping").alias("name", "given")).select("ord", "name", F.explode("given").alias("theme"))
    ranked = flat.join(F.broadcast(personas.select("name", F.col("ord").alias("rank"))), "name")
    return ranked.groupBy("ord", ascii_lower(F.col("theme")).alias("low")).agg(F.min_by("name", "rank").alias("persona"))


def _rotated(clusters: DataFrame, n: int, make: Callable[[DataFrame, int], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Up to n scenarios, at most ceil(n / clusters) of each cluster, in the order of ord; styles and
    lengths rotate. Clusters are taken in waves, so that no model is asked about those beyond need."""
    total = clusters.count()
    found, last, size = [], None, n
    per = ceil(n / total) if total else 0
    while total and len(found) < n:
        wave = keep((clusters if last is None else clusters.where(F.col("ord") > last)).orderBy("ord").limit(size))
        end = wave.agg(F.max("ord")).first()[0]
        if end is None:
            break
        few = F.row_number().over(Window.partitionBy("ord").orderBy("k"))
        made = make(wave, per).withColumn("_i", few).where(F.col("_i") <= per)
        found += made.orderBy("ord", "k").limit(n - len(found)).select("node_ids", "combination", "persona").collect()
        last, size = end, 2 * size
    rows = [(i, list(r["node_ids"]), list(r["combination"]), r["persona"], STYLES[i % len(STYLES)], LENGTHS[i % len(LENGTHS)]) for i, r in enumerate(found)]
    return clusters.sparkSession.createDataFrame(rows, "i int, node_ids array<string>, combination array<string>, persona string, style string, length string")


def multi_hop_specific(edges: DataFrame, entities: DataFrame, personas: DataFrame, n: int, provider, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scenarios over pairs of nodes that share entities: each theme of a pair that a persona cares for,
    with those of its nodes that hold it. edges: (ord, source_id, target_id, overlapped), of which the
    first of each pair counts; entities: (id, item)."""
    e = edges.where("source_id <> target_id").select("ord", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "overlapped")
    pairs = e.groupBy("a", "b").agg(F.min("ord").alias("ord"), F.min_by("overlapped", "ord").alias("overlapped")).select("ord", F.array("a", "b").alias("nodes"), overlap_themes(F.col("overlapped")).alias("themes"))
    pairs = keep(pairs)
    if pairs.isEmpty():
        raise ValueError("no edge between nodes that share entities")
    held = entities.select("id", ascii_lower(F.col("item")).alias("low")).distinct()

    def make(wave: DataFrame, per: int) -> DataFrame:
        named = match_themes(wave.select("ord", "themes"), personas, provider, keep)
        one = wave.select("ord", "nodes", F.posexplode("themes").alias("k", "theme")).withColumn("low", ascii_lower(F.col("theme"))).join(named, ["ord", "low"])
        at = one.select("ord", "k", "theme", "persona", "low", F.posexplode("nodes").alias("pos", "id")).join(held, ["id", "low"], "left_semi")
        own = at.groupBy("ord", "k", "theme", "persona").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("s"))
        return own.select("ord", "k", F.transform("s", lambda x: x["id"]).alias("node_ids"), F.array("theme").alias("combination"), "persona")

    return _rotated(pairs, n, make, keep)


def expand_children(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, nodes) with each node replaced by those its child edges lead to, if any; each once."""
    flat = clusters.select("ord", F.posexplode("nodes").alias("p", "source_id"))
    kids = edges.where("relationship = 'child'").select("source_id", "target_id", F.col("ord").alias("q"))
    all_ = flat.join(kids, "source_id", "left").select("ord", "p", "q", F.coalesce("target_id", "source_id").alias("id"))
    s = F.sort_array(F.collect_list(F.struct("p", "q", "id")))
    return all_.groupBy("ord").agg(F.array_distinct(F.transform(s, lambda x: x["id"])).alias("nodes"))


def multi_hop_abstract(clusters: DataFrame, edges: DataFrame, themes: DataFrame, personas: DataFrame, n: int, provider, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scenarios over clusters (ord, nodes) of similar nodes: the model combines concepts of their
    nodes; each combination that a persona cares for counts, with the nodes that hold any of it.
    themes: (id, themes array)."""
    low = lambda c: F.transform(c, ascii_lower)
    wide = keep(expand_children(clusters, edges))

    def make(wave: DataFrame, per: int) -> DataFrame:
        at = wave.select("ord", F.posexplode("nodes").alias("p", "id")).join(themes, "id", "left")
        lists = at.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("p", "id", F.coalesce("themes", F.array().cast("array<string>")).alias("themes")))).alias("lists"))
        some = F.exists("lists", lambda x: F.size(x["themes"]) > 0)
        prompt = F.concat(F.lit(f"at most {per} combinations of: "), F.to_json(F.transform("lists", lambda x: x["themes"])))
        told = _sound(keep(ask(lists, provider, keep, prompt, some, "combinations array<array<string>>")))
        told = told.select("ord", "lists", F.filter("got.combinations", lambda x: F.size(x) > 0).alias("found")).where(F.size("found") > 0)
        named = match_themes(told.select("ord", F.flatten("found").alias("themes")), personas, provider, keep)
        rank = personas.select(F.col("name").alias("persona"), F.col("ord").alias("rank"))
        one = told.select("ord", "lists", F.posexplode("found").alias("k", "combination"))
        cares = one.select("ord", "k", F.explode(low("combination")).alias("low")).join(named, ["ord", "low"]).join(F.broadcast(rank), "persona").groupBy("ord", "k").agg(F.min_by("persona", "rank").alias("persona"))
        ids = F.transform(F.filter("lists", lambda x: F.arrays_overlap(low(x["themes"]), low(F.col("combination")))), lambda x: x["id"])
        return one.join(cares, ["ord", "k"]).select("ord", "k", ids.alias("node_ids"), "combination", "persona").where(F.size("node_ids") > 0)

    return _rotated(wide, n, make, keep)


def scenario_samples(scenarios: DataFrame, nodes: DataFrame, personas: DataFrame, provider, keep: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """A question and a grounded answer per scenario (i, node_ids, combination, persona, style, length).
    One node gives its bare text, and none without text; several give their texts with hop tags."""
    at = scenarios.select("i", F.posexplode("node_ids").alias("p", "id")).join(nodes.select("id", F.col("props")["text"].alias("t")), "id", "left")
    texts = at.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", F.coalesce("t", F.lit("")).alias("t")))), lambda x: x["t"]).alias("texts"))
    s = scenarios.join(texts, "i").join(F.broadcast(personas.select(F.col("name").alias("persona"), "role")), "persona")
    s = s.withColumn("reference_contexts", F.when(F.size("texts") == 1, F.col("texts")).otherwise(multi_hop_contexts()))
    s = s.where((F.size("texts") > 1) | ~is_blank(F.get("texts", F.lit(0))))
    prompt = F.concat(F.lit("question and answer for: "), F.to_json(F.struct("persona", "role", F.col("combination").alias("themes"), "style", "length")), F.lit("\ncontext: "), F.array_join("reference_contexts", "\n\n"))
    told = keep(ask(s, provider, keep, prompt, F.lit(True), "query string, answer string"))
    lacks = F.when(F.col("got.query").isNull() | F.col("got.answer").isNull(), "parse error: query or answer is missing")
    told = _sound(told.withColumn("failed", F.coalesce("failed", lacks)))
    return told.select("i", F.col("got.query").alias("user_input"), F.col("got.answer").alias("reference"), "reference_contexts", "node_ids", "persona", "style", "length", F.lit(name).alias("synthesizer_name"))


def multi_hop_contexts(ids: list[str] | None = None, texts=None):
    """Texts of a cluster with the tag of their hop."""
    texts = F.col("texts") if texts is None else texts
    return F.transform(texts, lambda t, i: F.concat(F.lit("<"), (i + 1).cast("string"), F.lit("-hop>\n\n"), F.coalesce(t, F.lit(""))))


def cluster_themes(edges: DataFrame) -> DataFrame:
    return edges.withColumn("themes", overlap_themes(F.col("overlapped")))


def template_samples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Samples without a model: one per chunk, and one per pair of neighbouring chunks."""
    chunk = nodes.where("node_type = 'chunk'").select("id", F.col("props")["text"].alias("text"))
    one = chunk.select(F.concat(F.lit("What does this passage say? "), F.left("text", F.lit(80))).alias("user_input"), F.col("text").alias("reference"), F.array("text").alias("retrieved_contexts"), F.array("id").alias("source_ids"), F.lit(1).alias("hop_count"))
    a, b = chunk.select(F.col("id").alias("source_id"), F.col("text").alias("ta")), chunk.select(F.col("id").alias("target_id"), F.col("text").alias("tb"))
    pair = edges.where("relationship = 'next'").join(a, "source_id").join(b, "target_id")
    two = pair.select(F.concat(F.lit("How do these passages relate? "), F.left("ta", F.lit(40)), F.lit(" / "), F.left("tb", F.lit(40))).alias("user_input"), F.concat_ws("\n", "ta", "tb").alias("reference"), F.array("ta", "tb").alias("retrieved_contexts"), F.array("source_id", "target_id").alias("source_ids"), F.lit(2).alias("hop_count"))
    return one.unionByName(two)


def splits(n: int, weights: list[float]) -> list[int]:
    """How many samples each synthesizer makes: rounded up, n in all."""
    out, left = [], n
    for w in weights:
        k = min(left, ceil(n * w))
        out.append(k)
        left -= k
    return out
