"""Connected components by alternating large-star and small-star.

Each large-star step joins every larger neighbour of a node to the smallest node in the neighbourhood, each small-star step
joins a node and its smaller neighbours to the smallest of them. Neighbourhoods are never gathered: the minimum comes
from a partially aggregated groupBy and goes back by a join, which AQE may split, so a node with very many neighbours
is no single group. Edges stay linear in number. Every step is a table in the shared folder. The steps end when the edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """edges (a, b), a > b: every larger neighbour of a node goes to the least of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a > b").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """No node is both an end and a root, and each end has one root: then the edges are the components."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Of undirected edges (a, b) of any order: (node, root) for every node that isn't its component's minimum.

    Null nodes, loops and repeated edges are ignored.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, step = scratch.table(edges, f"{name}-0"), 0
    while not _is_stars(edges):
        for star in (_large, _small):
            step += 1
            edges = scratch.table(star(edges), f"{name}-{step}")
            scratch.drop(f"{name}-{step - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
