"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` has one edge and is no ``b``, so that ``b`` is its root already."""
    below = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    above = edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    nodes = below.unionByName(above).groupBy("node").agg((F.sum("below") + F.max("above")).alias("n"))
    return (nodes.agg(F.max("n")).first()[0] or 0) <= 1


def _contracted(now: DataFrame) -> DataFrame:
    """A large star, then a small star of the edges (a, b) with a > b."""
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
    large = now.join(low, now.b == low.u).select("a", F.col("m").alias("b"))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return small.where("a != b").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) that reaches a smaller one, with the smallest.

    Each round links every larger neighbour of a node to the smallest one
    (large star), then every node to its smallest neighbour (small star).
    Both are a partial minimum and a join, so a node that touches a third of
    all edges is no hot group. The rounds end when only stars are left: none
    is needed for edges that are stars, about log n for a path of n nodes.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while not _are_stars(now):
        now = materialize(_contracted(now), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def extended(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The (node, root) of ``roots`` after some of its roots, and nodes it lacks, got the roots in ``more``."""
    further = more.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    moved = roots.join(further, roots.root == further._node, "left")
    return moved.select("node", F.coalesce("_root", "root").alias("root")).unionByName(more)
