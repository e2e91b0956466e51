"""Connected components of an edge list, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, join_hot, stored


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _neighbours(e: DataFrame) -> DataFrame:
    """``a, m, n, down``: each node with the smallest of itself and its neighbours, their number, and how many are smaller."""
    met = _both(e).groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"), F.count_if(F.col("b") < F.col("a")).alias("down"))
    return met.select("a", F.least("a", "m").alias("m"), "n", "down")


def _large_star(e: DataFrame, near: DataFrame, total: int) -> DataFrame:
    return join_hot(_both(e).where("b > a"), near.select("a", "m", "n"), "a", "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _lowest(e: DataFrame) -> DataFrame:
    return e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))


def _small_star(e: DataFrame, total: int, low: DataFrame | None = None) -> DataFrame:
    """``e`` leads from larger nodes to smaller ones; ``low`` is its ``_lowest``."""
    low = _lowest(e) if low is None else low
    # a node is linked to its least neighbour once, and each of the others to that one
    return join_hot(e, low, "a", "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the smallest node of its component.

    The star steps keep the number of edges within that of the input, so no round grows; a round's tables are written
    to the shared folder, which cuts the lineage and survives lost executors, and deleted when the next round's
    are there. A star's node is pre-aggregated by ``min``; hot nodes are joined by broadcast. What a large star
    needs of each node also tells whether all components are stars by now: no node has two smaller neighbours, or one and
    a larger one. So the last round is not made twice, and edges that are stars from the start cost none.
    Null ends and self loops are ignored; an edge may repeat.
    """
    ends = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a) != F.col(b)).alias("apart"))
    e = stored(ends.where("apart").select("a", "b").distinct(), "edges")
    for _ in range(max_rounds):
        near = stored(_neighbours(e), "nodes")
        total, open_nodes = near.agg(F.coalesce(F.sum("n"), F.lit(0)), F.expr("count_if(down > 1 OR down = 1 AND n > 1)")).first()
        if not open_nodes:
            dropped(e)
            return near.select(F.col("a").alias("node"), F.col("m").alias("root"))
        large = stored(_large_star(e, near, total), "edges")
        low = stored(_lowest(large), "lowest")
        last, e = e, stored(_small_star(large, total // 2, low).distinct(), "edges")
        for old in (last, near, large, low):
            dropped(old)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
