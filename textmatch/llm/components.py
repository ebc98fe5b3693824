"""Connected components by alternating large and small stars over an edge table.

Each half step sends every neighbour of a node to the least node it sees, so the edges never
grow in number and the depth of every tree falls at each step; a few steps do for any graph
met in practice, about the square of the logarithm of its size at worst. The steps are grouped
minima and joins of two-column rows; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmatch.config import materialize


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): each node with the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges go from the larger node ``u`` to the smaller ``v``."""
    least = _least(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of ``links`` but the least of its component, and that one."""
    edges = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    edges = materialize(edges.distinct(), "edges")
    while True:
        # Done when every node that has a parent has one only, and that one has none.
        parents = edges.groupBy("u").agg(F.count("*").alias("n"))
        loose = parents.where("n > 1").select("u").union(
            edges.select(F.col("v").alias("u")).distinct().join(parents, "u", "left_semi")
        )
        if loose.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = materialize(_small_star(_large_star(edges)), "edges")
