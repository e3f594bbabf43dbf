"""Connected components of an edge table, as Spark joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import discard, materialize


def flatten(parents: DataFrame) -> DataFrame:
    """``(node, parent)`` with one parent per node, parent <= node: parents become roots by doubling."""
    current = held = materialize(parents, "forest")
    while True:
        up = current.select(F.col("node").alias("up_node"), F.col("parent").alias("up_parent"))
        new = materialize(current.join(up, F.col("parent") == F.col("up_node"), "left").select(
            "node", F.coalesce("up_parent", "parent").alias("parent"),
            (F.coalesce("up_parent", "parent") != F.col("parent")).alias("moved")), "forest")
        discard(held)
        moved, held = new.agg(F.max("moved")).first()[0], new
        current = new.drop("moved")
        if not moved:
            return current


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(a, b)`` edges; ``root`` is the smallest node reachable.

    Each round hooks every node on its smallest neighbour and flattens the forest, then edges are
    rewritten to roots; edges inside a tree vanish. Rounds grow with the logarithm of the longest path.
    """
    edges = materialize(edges.where("a <> b").select("a", "b"), "edges")
    labels = materialize(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
                         .distinct().withColumn("root", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        roots = flatten(hooks.select("node", F.least("node", "low").alias("parent")))
        before = labels, edges
        labels = materialize(labels.join(roots, F.col("root") == roots["node"], "left").select(
            labels["node"], F.coalesce(roots["parent"], labels["root"]).alias("root")), "labels")
        left = roots.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        right = roots.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        edges = materialize(edges.join(left, "a").join(right, "b").where("root_a <> root_b").select(
            F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
        discard(*before)
    return labels
