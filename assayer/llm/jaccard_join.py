"""N-gram Jaccard join of a table with itself, as a grouped prefix join, and its components.

1. One pass over the texts makes, per document, the size and a fingerprint of its set of word
   shingles and those shingles that fall into a fixed part of the hash range (the front). Documents
   with equal sets are one node from here on, so exact copies never meet in pairs.
2. A set of n shingles that links must share one of any n - ceil(t n) + 1 of its shingles. Nodes
   with that many front shingles that no other set has link with nothing and are done.
3. For the others the whole sets are counted: the prefix of a node is its rarest shingles. Nodes
   with the same prefix and size form a group.
4. Prefix shingles that at most ``few`` nodes have are joined to distinct pairs of groups, filtered by
   size and by the place of their first common shingle, then expanded to members and verified.
5. The groups that hold a more frequent prefix shingle, as those of many near copies do, are not
   paired one by one: they are split into blocks (by what such shingles connect), and pairs of blocks
   are verified in one task each, which filters groups by size and shared prefix, expands them and
   computes the overlap of all members at once by a sparse-column matrix product. A task returns a
   spanning forest of its links and how many each member has, so the rows stay linear however many
   pairs link.
6. The components of pairs and forests are those of the links.

Shingles are 64-bit hashes of the words. Only integers are shuffled, never text.

Defined cases: no words (null, empty or blank text) means an empty set that links with nothing;
fewer words than k are one shingle of all of them; a doc_id given twice with different texts is one
node per text, each in the component of its own text, and components of the same least doc_id have
the same name; a null doc_id gets a null component and
gives no name to one; ties and repeated rows share a component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Workspace
from .components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 1 << 25  # of the filter that spares most texts the second pass: 4 MB


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    k = min(k, len(words))
    n = len(words) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = (x ^ h[i : i + n]) * _MIX
        x ^= x >> np.uint64(29)
    return np.unique(x)


def set_name(hashes: np.ndarray) -> int:
    """A fingerprint of a set of shingles: a sum of mixed hashes, the same in any order."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(31))) * _MIX
        return int((x ^ (x >> np.uint64(29))).sum(dtype=np.uint64) ^ (np.uint64(len(hashes)) * _MIX))


def _signatures(stream: Iterator[pa.RecordBatch], k: int, front: int) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        sets = [shingle_hashes(t.as_py(), k) for t in batch.column("text")]
        names = np.array([set_name(s) for s in sets], np.uint64).view(np.int64)
        low = [s[: np.searchsorted(s, np.uint64(front))].view(np.int64) for s in sets]
        cols = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names), pa.array(low, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "node", "low"])


def _sets(stream: Iterator[pa.RecordBatch], k: int, bits) -> Iterator[pa.RecordBatch]:
    """Whole sets of the documents whose doc_id may be a representative's."""
    held = np.frombuffer(bits.value, np.uint8)
    for batch in stream:
        ids = batch.column("doc_id").fill_null(0).to_numpy()
        slot = ids & (_BITS - 1)
        take = np.flatnonzero((held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        sets = [shingle_hashes(batch.column("text")[int(i)].as_py(), k) for i in take]
        names = np.array([set_name(s) for s in sets], np.uint64).view(np.int64)
        cols = [batch.column("doc_id").take(pa.array(take)), pa.array(names), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_node", "sig"])


def _shared(rows: DataFrame, by: str) -> DataFrame:
    """The hashes h that more than one distinct value of ``by`` has: two aggregates per hash, merged
    before the shuffle."""
    return rows.groupBy("h").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo <> hi").select("h")


def _verify(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links between the members of two blocks (or within one): per member that links (a) the root of
    its tree (b, null for the root) and the number of documents it links with (links).

    Columns: node, named, grp, side (0 or 1), sig, pref. Overlaps are counted over the shingles that at
    least two members have, in column slices of bounded size.
    """
    n = len(pdf)
    sizes = np.array([len(s) for s in pdf["sig"]], np.int64)
    side = pdf["side"].to_numpy()
    groups, member = np.unique(pdf["grp"].to_numpy(), return_inverse=True)
    cand = np.zeros((len(groups), len(groups)), bool)
    first = np.unique(member, return_index=True)[1]
    for cols, rows in _slices([pdf["pref"].iloc[i] for i in first]):
        x = np.zeros((len(groups), cols), np.float32)
        x[rows] = 1
        cand |= (x @ x.T) > 0
    gs = sizes[first]
    cand &= np.minimum.outer(gs, gs) * den >= num * np.maximum.outer(gs, gs)
    np.fill_diagonal(cand, True)
    live = cand.any(axis=1)
    overlap = np.zeros((n, n))
    if live.any():
        for cols, rows in _slices(pdf["sig"].tolist()):
            x = np.zeros((n, cols), np.float32)
            x[rows] = 1
            overlap += x @ x.T
    union = sizes[:, None] + sizes[None, :] - overlap
    link = (overlap * den >= num * union) & cand[np.ix_(member, member)]
    if (side == 1).any():
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    root = np.arange(n)
    while True:  # least label over neighbours, with pointer jumping
        least = np.where(link, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, least)
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            break
        root = new
    nodes = pdf["node"].to_numpy()
    keep = link.any(axis=1)
    tree = pd.array(nodes[root[keep]], dtype="Int64")
    tree[(root == np.arange(n))[keep]] = pd.NA
    return pd.DataFrame({"a": nodes[keep], "b": tree, "links": (link[keep] @ pdf["named"].to_numpy(np.int64)).astype(np.int64)})


def _slices(lists: list[np.ndarray], cells: int = 4_000_000):
    """(number of columns, (row indexes, column indexes)) slices of the incidence matrix of those
    values that occur in more than one list."""
    if not lists:
        return
    lens = [len(x) for x in lists]
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists])
    own = np.repeat(np.arange(len(lists)), lens)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[col] > 1
    own, (_, col) = own[keep], np.unique(col[keep], return_inverse=True)
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    step = max(1, cells // len(lists))
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        a, b = np.searchsorted(col, [lo, lo + step])
        yield step, (own[a:b], col[a:b] - lo)


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, front: float = 0.25, block_nodes: int = 400, block_shingles: int = 300_000, links: bool = False, few: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs. Two sets link when
    100 * intersection >= percent * union. With links also n_links, the number of other rows with a
    doc_id that link with the row; null for a null doc_id."""
    found = _components(docs, k, percent, front, block_nodes, block_shingles, few)
    return found.select("doc_id", "n_shingles", "component_id", *["n_links"] * links)


def _components(docs: DataFrame, k: int, percent: int, front: float = 0.25, block_nodes: int = 400, block_shingles: int = 300_000, few: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, head, n_links): node is the fingerprint of the row's set and
    head that of the set that names the component, which two components of one name do not share."""
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    edge = int(front * 2.0**64)
    seen = work.keep(texts.mapInArrow(lambda it: _signatures(it, k, edge), "doc_id long, n long, node long, low array<long>"), "front")
    ids = work.keep(seen.select("doc_id", "n", "node"), "ids")
    least = F.ceil(F.col("n") * percent / F.lit(100.0) - F.lit(1e-9))
    nodes = work.keep(seen.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.count("doc_id").alias("named"), F.first("n").alias("n"), F.first(F.size("low")).alias("n_low")), "nodes")

    # 2. Whoever has enough shingles of its own among the front ones links with nothing.
    low = seen.where("n > 0").select("node", F.explode("low").alias("h"))
    shared = work.keep(_shared(low, "node"), "shared")  # one shuffle of the hashes is over before the next begins
    met = low.join(shared, "h").groupBy("node").agg(F.count("*").alias("met"))
    need = (F.col("n") - least + 1).cast("long")
    alive = nodes.join(met, "node", "left").where(F.col("n_low") - F.coalesce("met", F.lit(0)) / F.col("copies") < need).where("rep is not null").select("node", "rep", "n", "named")
    alive = work.keep(alive, "alive")
    work.drop(seen, shared)
    bits = spark.sparkContext.broadcast(_bitmap(alive))
    sets = texts.mapInArrow(lambda it: _sets(it, k, bits), "doc_id long, _node long, sig array<long>")
    # A node has one rep: by the keys of the join, repeated rows go without another shuffle of whole sets.
    named = sets.join(alive, (sets["_node"] == alive["node"]) & (sets["doc_id"] == alive["rep"])).dropDuplicates(["node", "rep"]).select("node", "n", "named", "sig")
    sets = work.keep(named, "sets")

    # 3. Rarest shingles first; what only one node has links it with nothing.
    rows = sets.select("node", F.explode("sig").alias("h"))
    often = work.keep(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    common = rows.join(often, "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("common"))
    own = F.col("n") - F.size("common")
    prefixes = sets.select("node", "n").join(common, "node").withColumn("own", own).where(F.col("own") < need)
    prefixes = prefixes.select("node", "n", "own", F.transform(F.slice("common", 1, (need - F.col("own")).cast("int")), lambda x: x["h"]).alias("pref"))
    # A node with a shingle of its own in its prefix shares that prefix with nobody.
    key = F.when(F.col("own") == 0, F.xxhash64("n", "pref")).otherwise(F.xxhash64("n", "pref", "node"))
    prefixes = work.keep(prefixes.withColumn("grp", key), "prefixes")
    work.drop(often)
    hits = prefixes.groupBy("grp").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.count("*").alias("w"), F.first("pref").alias("pref"))
    hits = work.keep(hits.select("grp", "n", "w", "own", F.posexplode("pref").alias("pos", "h")).withColumn("pos", F.col("own") + F.col("pos") + 1), "hits")
    spread = hits.groupBy("h").agg(F.sum("w").alias("spread"), F.count("*").alias("groups"))
    hits = work.keep(hits.join(spread.where("groups > 1 or spread > " + str(few)), "h").withColumn("hot", F.col("spread") > few), "spread")

    # 5. What frequent prefix shingles connect, in blocks of bounded size.
    hot = hits.where("hot").select("grp", "h")
    hubs = hot.groupBy("h").agg(F.min("grp").alias("hub"))
    roots = components(work, hot.join(hubs, "h").select(F.col("grp").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("grp"), "root")
    # A group alone with its frequent shingles is linked with no other, so that no component holds it.
    alone = hot.select("grp").distinct().join(roots, "grp", "left_anti").select("grp", F.col("grp").alias("root"))
    roots = work.keep(roots.unionByName(alone), "roots")

    # 4. Pairs of groups by rarer shingles, but for those that meet in blocks.
    rare = hits.where("not hot").join(roots, "grp", "left").select("h", "grp", "n", "pos", "root")
    x, y = (rare.select("h", *[F.col(c).alias(c + i) for c in ("grp", "n", "pos", "root")]) for i in "12")
    met = x.join(y, "h").where("grp1 < grp2 and (root1 is null or root2 is null or root1 <> root2)").where(F.least("n1", "n2") * 100 >= percent * F.greatest("n1", "n2"))
    met = met.groupBy("grp1", "grp2").agg(F.min("pos1").alias("pos1"), F.min("pos2").alias("pos2"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.first("root1").alias("root1"), F.first("root2").alias("root2"))
    # Where one has no frequent shingle, no common one stands before the first that was met.
    room = 1 + F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    met = met.where(F.col("root1").isNotNull() & F.col("root2").isNotNull() | (room * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent))
    members = prefixes.select("grp", "node")
    met = met.select(F.col("grp1").alias("grp"), "grp2").join(members, "grp").select(F.col("grp2").alias("grp"), F.col("node").alias("a")).join(members, "grp").select("a", F.col("node").alias("b"))
    within = members.join(hits.select("grp").where("hot").distinct(), "grp", "left_anti").groupBy("grp").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes").between(2, few))
    within = within.select(F.explode("nodes").alias("a"), "nodes").select("a", F.explode("nodes").alias("b")).where("a < b")
    chosen = work.keep(met.unionByName(within), "pairs")
    held = sets.select("node", "n", "named", "sig")
    left, right = (held.select(*[F.col(c).alias(c + i) for c in held.columns]) for i in "ab")
    linked = chosen.join(left, F.col("a") == F.col("nodea")).join(right, F.col("b") == F.col("nodeb"))
    common = F.size(F.array_intersect("siga", "sigb"))
    linked = linked.where((common * (100 + percent)) >= (F.col("na") + F.col("nb")) * percent).select("a", "b", "nameda", "namedb")
    linked = work.keep(linked, "linked")
    pair_links = linked.select("a", "b", F.col("namedb").alias("links")).unionByName(linked.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("b"), F.col("nameda").alias("links")))

    placed = work.keep(prefixes.join(roots, "grp").select("node", "n", "grp", "pref", "root"), "placed")
    load = placed.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("weight")).where("members > 1")
    load = load.select("root", F.greatest(F.ceil(F.col("members") / block_nodes), F.ceil(F.col("weight") / block_shingles)).cast("int").alias("blocks"))
    placed = placed.join(load, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("node", "grp", "pref", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    full = pairs.join(sets.select("node", "named", "sig"), "node")
    links = full.groupBy("root", "i", "j").applyInPandas(lambda pdf: _verify(pdf, percent, 100), "a long, b long, links long")
    links = work.keep(links.unionByName(pair_links), "links")
    work.drop(sets, prefixes, hits)
    member = components(work, links.where("b is not null").select("a", "b"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))

    # 5. Names: the least doc_id of a component.
    member = nodes.select("node", "rep").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_ids = member.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("least"))
    least_ids = least_ids.select("root", F.col("least")["rep"].alias("component_id"), F.col("least")["node"].alias("head"))
    moved = member.join(least_ids, "root").where("head <> node").select("node", "component_id", "head")
    copied = nodes.where("copies > 1").select("node", "rep", "named")
    n_links = (F.greatest(F.coalesce("named", F.lit(1)) - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links")
    names = work.keep(copied.join(moved, "node", "full").join(counts, "node", "full").select("node", n_links, F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("head", "node").alias("head")), "names")
    done = ids.join(names, "node", "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"), "node", F.coalesce("head", "node").alias("head"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0)).alias("n_links"))


def _bitmap(alive: DataFrame) -> bytes:
    """A filter of fixed size over the representatives' ids, in rows of 32,768 bits."""
    slot = F.pmod("rep", F.lit(_BITS)) + 1
    rows = alive.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    held = bytearray(_BITS // 8)
    for r in rows.toLocalIterator():  # at most _BITS / 32768 rows
        held[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(held)


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, most_broadcast: int = 500_000) -> DataFrame:
    """The rows of docs that name their component; of rows that repeat a doc_id and a set of
    shingles, one. Rows with a null doc_id stay. A doc_id decides for its rows where they have one
    set; the rows of other ids are told apart by their sets. Texts are shuffled only where the ids to
    leave out are too many to broadcast (``most_broadcast`` of them take some 10 MB)."""
    work = Workspace(docs.sparkSession, "kept")
    found = work.keep(_components(docs, k, percent), "components").where("doc_id is not null")
    left_out = F.when(F.col("component_id") == F.col("doc_id"), F.col("head") != F.col("node")).otherwise(F.lit(True))
    ids = work.keep(found.groupBy("doc_id").agg(F.count("*").alias("c"), (F.min("node") != F.max("node")).alias("mixed"), F.max(left_out).alias("gone")).where("c > 1 or gone"), "decided")
    gone, twice, mixed = (ids.where(x).select("doc_id") for x in ("gone and not mixed", "c > 1 and not mixed and not gone", "mixed"))
    small = lambda t: F.broadcast(t) if t.count() <= most_broadcast else t
    kept = docs.join(small(gone), "doc_id", "left_anti")
    if not twice.isEmpty():
        t = small(twice)
        kept = kept.join(t, "doc_id", "left_anti").unionByName(kept.join(t, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    if mixed.isEmpty():
        return kept
    t = small(mixed)
    pairs = work.keep(found.join(t, "doc_id", "left_semi").where(left_out).select("doc_id", F.col("node").alias("_node")).distinct(), "pairs")
    told = docs.join(t, "doc_id", "left_semi").withColumn("text", F.col("text").cast("string"))
    told = told.mapInArrow(lambda it: _with_nodes(it, k), StructType([*told.schema.fields, StructField("_node", LongType())]))
    told = told.join(small(pairs), ["doc_id", "_node"], "left_anti").dropDuplicates(["doc_id", "_node"])
    return kept.join(t, "doc_id", "left_anti").unionByName(told.drop("_node"))


def _with_nodes(stream: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        names = np.array([set_name(shingle_hashes(t.as_py(), k)) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names)], [*batch.schema.names, "_node"])
