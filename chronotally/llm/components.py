"""Connected components of a large graph, by alternating large-star and small-star steps.

Each step only sends (vertex, smaller neighbour) pairs: the minimum of a vertex is a partial aggregate, and the join that brings it back
to the vertex's edges may be split where a vertex has many. Edges are staged after each round, the round's tables deleted, and rounds end when they no
longer change (about the logarithm of the longest path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import drop, stage


def _large_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest vertex around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    used.append(least)
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    used.append(least)
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """vertex, root (its component's smallest vertex) for every vertex of ``edges`` (a, b: long). No edges give no rows."""
    # minima are staged, so that each join stands on its own shuffles, which may be split at a vertex of many edges
    now = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        used = [now]
        now = stage(_small_star(_large_star(now, used), used).where("a <> b").distinct(), "edges")
        drop(*used)  # a round's tables end with it
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
