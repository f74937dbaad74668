"""Connected components by alternating large-star and small-star steps; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Each step keeps the components and shortens the paths; it ends once a step changes nothing. Self
    links and repeated edges are allowed, rows with a null are ignored.
    """
    now = stash(_small(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    mark = _mark(now)
    while mark[0]:
        now = stash(_small(_large(now)), "edges")
        if (after := _mark(now)) == mark:
            break
        mark = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour or itself."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    least = stash(least, "least")  # so that the join shuffles both sides anew and can split a hub's edges
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them. Edges point from larger to smaller."""
    least = stash(edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("n", "m")).distinct()
