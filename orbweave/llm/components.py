"""Connected components of a graph held in DataFrames, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its other smaller neighbours and to itself."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: one orderable type, no nulls); root is the component's smallest node.

    Each round writes its edges to the shared folder, so the plan doesn't grow and a lost executor costs one round at most.
    A root's own row (root, root) is part of the result. No edges give no rows.
    """
    edges = materialise(edges.where("a != b").distinct(), "edges")
    mark = None
    while True:
        edges = materialise(_small(_large(edges)), "edges")
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if (now["n"], now["x"]) == mark:
            break
        mark = (now["n"], now["x"])
    # each node now has one edge, to its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
