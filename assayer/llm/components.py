"""Connected components of an edge table, by alternating large and small stars.

Every round is a pair of aggregations and joins on node ids; the edges never grow. Hub nodes are
aggregated on the map side and their join is one that adaptive execution can split. Tables are
written to the shared folder each round, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours are linked to the least of them and itself: for a large star those
    above the node, for a small star those below."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = near.join(least, "u")
    moved = near.where("m <> v" if small else "v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if small:
        moved = moved.unionByName(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component."""
    edges = work.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = work.keep(_star(_star(edges, False), True), "edges")
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        work.drop(edges)
        edges = now
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
