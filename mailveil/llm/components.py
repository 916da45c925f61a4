"""Connected components of a graph that no machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def large_star(edges: DataFrame) -> DataFrame:
    """Join each larger neighbour of a vertex to the smallest vertex around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.filter("b > a").join(least, "a").select(
        F.col("b").alias("a"), F.col("least").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Join a vertex and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    joined = edges.join(least, "a").filter("b <> least").select(
        F.col("b").alias("a"), F.col("least").alias("b"))
    return joined.unionByName(least.select("a", F.col("least").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(vertex, root)`` for each vertex of ``edges(a, b)``; the root is the smallest vertex
    of its component and is listed too.

    Rounds of large-star and small-star until nothing changes, their number logarithmic in
    the vertices in practice. Each round is written to the shared folder, so a lost executor
    costs a part of a round. Only a count and a sum per round reach the driver.
    """
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = settle(edges, "links"), None
    while True:
        edges = settle(small_star(large_star(edges).distinct()).distinct(), "links")
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)
