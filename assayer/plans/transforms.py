"""Transforms of a graph (nodes, edges) as functions, the default pipeline, and test sets from graphs.

A step takes a graph and returns one; steps are applied in order, a list among them like its members.
Vectors and lists stand in props as JSON.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from assayer.functions.text import ascii_lower, is_blank
from assayer.operators.aggregates import transform_branch
from assayer.operators.chunking import chunk_documents, split_at_headlines
from assayer.operators.graph import contains_edges, entity_nodes, path_clusters
from assayer.plans import testset as S
from assayer.plans.judges import ask

Graph = tuple[DataFrame, DataFrame]
Keep = Callable[[DataFrame], DataFrame]
Step = Callable[[Graph], Graph]


def similar(edges: DataFrame) -> DataFrame:
    """Edges between nodes of similar vectors or summaries."""
    return edges.where((F.col("relationship") == "cosine_similarity") | F.col("props")["summary_similarity"].isNotNull())


def apply_transforms(graph: Graph, steps: Iterable[Step | list]) -> Graph:
    for s in steps:
        graph = apply_transforms(graph, s) if isinstance(s, list) else s(graph)
    return graph


def _some(nodes: DataFrame, node_type: str | None) -> DataFrame:
    return nodes if node_type is None else nodes.where(F.col("node_type") == node_type)


def extraction(kind: str, provider, keep: Keep, node_type: str | None = None) -> Step:
    """Writes what an extractor finds in nodes of a type into their property of its name."""
    return lambda g: (keep(S.with_property(g[0], S.extract(_some(g[0], node_type), kind, provider, keep), kind)), g[1])


def embedding(provider, keep: Keep, source: str = "text", name: str = "embedding", node_type: str | None = None, present: bool = False) -> Step:
    """Writes vectors of a property; with present only of the nodes that have it."""

    def step(g: Graph) -> Graph:
        chosen = _some(g[0], node_type)
        chosen = chosen.where(~is_blank(F.col("props")[source])) if present else chosen
        rest = g[0].join(chosen.select("id"), "id", "left_anti")
        return keep(S.embed(chosen, provider, keep, source, name).unionByName(rest)), g[1]

    return step


def _more(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """Further edges (source_id, target_id, relationship, props) after those there are."""
    last = edges.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    return edges.select("ord", "source_id", "target_id", "relationship", "props").unionByName(fresh.withColumn("ord", F.monotonically_increasing_id() + last + 1).select("ord", "source_id", "target_id", "relationship", "props"))


def cosine_step(threshold: float, keep: Keep, name: str = "embedding", score: str = "cosine_similarity") -> Step:
    def step(g: Graph) -> Graph:
        v = g[0].where(F.col("props")[name].isNotNull()).select("id", F.from_json(F.col("props")[name], "array<double>").alias("vector"))
        return g[0], keep(_more(g[1], S.similarity_edges(v, threshold, score)))

    return step


def overlap_step(keep: Keep, at: float = 0.9, least: float = 0.01) -> Step:
    def step(g: Graph) -> Graph:
        items = g[0].select(F.col("id").alias("grp"), "ord", F.posexplode(F.from_json(F.col("props")["entities"], "array<string>")).alias("k", "item"))
        items = items.select("grp", "item", F.struct("ord", "k").alias("position"))
        e = S.overlap_edges(items, at, least)
        props = F.create_map(F.lit("entities_overlap_score"), F.col("score").cast("string"), F.lit("overlapped_items"), F.to_json("overlapped"))
        return g[0], keep(_more(g[1], e.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("entities_overlap").alias("relationship"), props.alias("props"))))

    return step


def filter_step(provider, keep: Keep, least: int = 2) -> Step:
    def step(g: Graph) -> Graph:
        nodes, edges = S.filter_chunks(g[0], g[1], provider, keep, least)
        return keep(nodes.select("ord", "id", "node_type", "props")), keep(edges)

    return step


def headline_step(keep: Keep, least: int = 2000, most: int = 4000) -> Step:
    """Cuts documents at their headlines: chunk nodes, child edges to them and next edges between."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(text: pd.Series, headlines: pd.Series) -> pd.Series:
        return text.combine(headlines, lambda t, h: split_at_headlines(t or "", list(h) if h is not None else [], least, most))

    def step(g: Graph) -> Graph:
        nodes, edges = g
        docs = nodes.where("node_type = 'document'")
        heads = F.coalesce(F.from_json(F.col("props")["headlines"], "array<string>"), F.array().cast("array<string>"))
        flat = keep(docs.select("ord", F.col("id").alias("source"), F.posexplode(cut(F.coalesce(F.col("props")["text"], F.lit("")), heads)).alias("k", "text")).where(~is_blank(F.col("text"))))
        chunk_id = F.concat("source", F.lit("-chunk-"), F.col("k").cast("string"))
        last = nodes.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
        made = flat.select((F.monotonically_increasing_id() + last + 1).alias("ord"), chunk_id.alias("id"), F.lit("chunk").alias("node_type"), F.create_map(F.lit("text"), "text", F.lit("source_id"), "source", F.lit("chunk_index"), F.col("k").cast("string")).alias("props"))
        c = flat.select(F.col("source").alias("source_id"), chunk_id.alias("id"), F.col("k").alias("chunk_index"))
        e = contains_edges(c)
        fresh = e.select("source_id", "target_id", F.when(F.col("relationship") == "contains", "child").otherwise(F.col("relationship")).alias("relationship"), F.create_map(F.lit("order"), F.col("order").cast("string")).alias("props"))
        return keep(nodes.select("ord", "id", "node_type", "props").unionByName(made)), keep(_more(edges, fresh))

    return step


def default_steps(branch: str, llm, embedder, keep: Keep) -> list[Step | list]:
    """The steps of long documents (split) or of middling ones (no_split)."""
    if branch == "split":
        kind, near = "chunk", 0.7
        head = [extraction("headlines", llm, keep, "document"), headline_step(keep), extraction("summary", llm, keep, "document"), filter_step(llm, keep)]
    elif branch == "no_split":
        kind, near = "document", 0.5
        head = [extraction("summary", llm, keep, "document"), filter_step(llm, keep)]
    else:
        raise ValueError("the documents are too short for transforms")
    found = [extraction("themes", llm, keep, kind), extraction("entities", llm, keep, kind)]
    return [*head, embedding(embedder, keep, "summary", "summary_embedding", present=True), found, cosine_step(near, keep, "summary_embedding", "summary_similarity"), overlap_step(keep)]


def default_transforms(graph: Graph, llm, embedder, keep: Keep) -> Graph:
    """The default pipeline for the lengths of the graph's documents."""
    docs = graph[0].where("node_type = 'document'")
    if docs.isEmpty():
        raise ValueError("the graph has no documents")
    branch = transform_branch(docs, F.char_length(F.coalesce(F.col("props")["text"], F.lit("")))).first()["branch"]
    return apply_transforms(graph, default_steps(branch, llm, embedder, keep))


SINGLE, ABSTRACT, SPECIFIC = "single_hop_specific_query_synthesizer", "multi_hop_abstract_query_synthesizer", "multi_hop_specific_query_synthesizer"


def available(graph: Graph) -> list[str]:
    """The synthesizers for which the graph has what they need, in fixed order."""
    nodes, edges = graph
    out = []
    if not entity_nodes(nodes).isEmpty():
        out.append(SINGLE)
    if not similar(edges).where("source_id <> target_id").isEmpty():
        out.append(ABSTRACT)
    if not edges.where("relationship = 'entities_overlap' and source_id <> target_id").isEmpty():
        out.append(SPECIFIC)
    return out


def default_distribution(graph: Graph) -> list[tuple[str, float]]:
    names = available(graph)
    if not names:
        raise ValueError("the graph has neither entities nor overlapping entities nor similar nodes")
    return [(n, 1 / len(names)) for n in names]


@dataclass
class Generator:
    """Test sets from a transformed graph. distribution: (synthesizer, weight) pairs."""

    graph: Graph
    llm: object
    keep: Keep
    personas: DataFrame | None = None
    distribution: list[tuple[str, float]] | None = None

    def generate(self, size: int, personas: int = 3) -> DataFrame:
        """Up to ``size`` samples with synthesizer_name; a synthesizer that finds nothing adds none, and
        if none finds any that is an error."""
        nodes, edges = self.graph
        who = self.personas
        if who is None:
            held = nodes.where(F.col("props")["summary"].isNotNull() & F.col("props")["summary_embedding"].isNotNull())
            who = S.personas(held.select("ord", F.col("props")["summary"].alias("summary"), F.from_json(F.col("props")["summary_embedding"], "array<double>").alias("vector")), personas, self.llm, self.keep)
        who = self.keep(who.orderBy("ord").limit(personas))
        shares = self.distribution or default_distribution(self.graph)
        out, left = None, size
        for (name, _), n in zip(shares, S.splits(size, [w for _, w in shares]), strict=True):
            n = min(n, left)
            if not n:
                continue
            scenarios = self.scenarios(name, who, n)
            made = self.keep(S.scenario_samples(scenarios, nodes, who, self.llm, self.keep, name))
            left -= made.count()
            out = made if out is None else out.unionByName(made)
        if left == size:
            raise ValueError("no synthesizer made a sample")
        return out

    def scenarios(self, name: str, who: DataFrame, n: int) -> DataFrame:
        nodes, edges = self.graph
        terms = lambda key: F.from_json(F.col("props")[key], "array<string>")
        if name == SINGLE:
            themes = entity_nodes(nodes).select(F.col("ord").alias("node_ord"), F.col("id").alias("node_id"), F.posexplode(terms("entities")).alias("term_ord", "term"))
            groups = self.keep(themes.groupBy(F.col("node_ord").alias("ord")).agg(F.collect_list("term").alias("themes")))
            named = S.match_themes(groups, who, self.llm, self.keep)
            cares = themes.join(named.select(F.col("ord").alias("node_ord"), "low", "persona"), "node_ord").where(ascii_lower(F.col("term")) == F.col("low"))
            per = F.row_number().over(Window.partitionBy("node_id").orderBy("term_ord"))
            most = -(-n // max(1, groups.count()))
            few = cares.withColumn("_k", per).where(F.col("_k") <= most).orderBy("node_ord", "term_ord").limit(n).collect()
            rows = [(i, [r["node_id"]], [r["term"]], r["persona"], S.STYLES[i % len(S.STYLES)], S.LENGTHS[i % len(S.LENGTHS)]) for i, r in enumerate(few)]
            return nodes.sparkSession.createDataFrame(rows, "i int, node_ids array<string>, combination array<string>, persona string, style string, length string")
        if name == ABSTRACT:
            clusters = path_clusters(similar(edges), n, 3)
            made = nodes.sparkSession.createDataFrame([(i, sorted(c)) for i, c in enumerate(clusters)], "ord int, nodes array<string>")
            return S.multi_hop_abstract(made, edges, nodes.select("id", F.coalesce(terms("themes"), F.array().cast("array<string>")).alias("themes")), who, n, self.llm, self.keep)
        e = edges.where("relationship = 'entities_overlap'").select("ord", "source_id", "target_id", F.from_json(F.col("props")["overlapped_items"], "array<string>").alias("overlapped"))
        entities = nodes.select("id", F.explode(terms("entities")).alias("item"))
        return S.multi_hop_specific(e, entities, who, n, self.llm, self.keep)


def generate_testset(docs: DataFrame, llm, keep: Keep, most_bytes: int = 1000, multi_hop: bool = True) -> DataFrame:
    """From raw texts (doc_id, text): a question and answer per chunk, and per pair of neighbouring
    chunks: (user_input, response, reference, retrieved_contexts, synthesis_type, source_node_ids).
    Documents without text are an error; so is an answer without a question."""
    chunks = keep(chunk_documents(docs, most_bytes))
    if chunks.isEmpty():
        raise ValueError("the dataset is empty")
    one = chunks.select("source_id", "chunk_index", F.lit(1).alias("hop"), F.array("text").alias("contexts"), F.array("id").alias("ids"))
    w = Window.partitionBy("source_id").orderBy("chunk_index")
    two = chunks.select("source_id", "chunk_index", F.lit(2).alias("hop"), F.array("text", F.lead("text").over(w)).alias("contexts"), F.array("id", F.lead("id").over(w)).alias("ids")).where("ids[1] is not null")
    todo = one.unionByName(two) if multi_hop else one
    prompt = F.concat(F.when(F.col("hop") == 1, "question from one passage: ").otherwise("question from both passages: "), F.array_join("contexts", "\n---\n"))
    told = keep(ask(todo, llm, keep, prompt, F.lit(True), "question string, answer string"))
    lacks = F.when(is_blank(F.col("got.question")) | is_blank(F.col("got.answer")), "parse error: question or answer is blank")
    told = S._sound(told.withColumn("failed", F.coalesce("failed", lacks)))
    kind = F.when(F.col("hop") == 1, "single-hop").otherwise("multi-hop")
    return told.select("source_id", "hop", "chunk_index", F.col("got.question").alias("user_input"), F.col("got.answer").alias("response"), F.col("got.answer").alias("reference"), F.col("contexts").alias("retrieved_contexts"), kind.alias("synthesis_type"), F.array_join("ids", ",").alias("source_node_ids"))
