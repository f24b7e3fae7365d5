"""Connected components of a distributed edge list, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.tables import stored


def _minimum_edges(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))


def _jump(parents: DataFrame) -> DataFrame:
    """Follow parents until every node points at a root; each pass halves the depth."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved = parents.join(up, "label", "left").select(
            "node", F.coalesce("above", "label").alias("to"), (F.coalesce("above", "label") != F.col("label")).alias("moved")
        )
        moved = stored(moved, "parents")
        parents = moved.select("node", F.col("to").alias("label"))
        if moved.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges(a, b)``: the smallest node it can reach.

    Every round points each node at its smallest neighbour, shortens the paths and
    contracts the edges to their roots; the number of groups falls by half at least.
    Only label tables are kept, in the shared folder. Loops and repeated edges are
    allowed; no edges give no rows.
    """
    labels = None
    edges = stored(edges.select("a", "b").distinct(), "edges")
    while True:
        roots = _jump(stored(_minimum_edges(edges), "hooks"))
        if labels is None:
            labels = roots
        else:
            step = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = stored(
                labels.join(step, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels"
            )
        left = roots.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = roots.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = stored(
            edges.join(left, "a").join(right, "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(),
            "edges",
        )
        if edges.isEmpty():
            return labels
