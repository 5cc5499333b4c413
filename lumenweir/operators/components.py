"""Connected components of an edge table, by alternating large-star and small-star joins until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b); root: the smallest node that can be reached.

    Self-links, repeated and reversed links, and nulls are no links. An empty table gives no rows. Each round is written
    to the shared folder. The number of rounds grows as the logarithm of the longest chain; every round is linear in edges.
    Links that lead each node to its component's smallest one straight away need none.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(edges):
        edges = stored(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one edge, and none is a smaller end as well."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.where("up + down > 1 and up > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to its smallest neighbour (or itself)."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
    return edges.join(least, edges.v == least.x).where("u <> m").select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, are linked to the smallest of them."""
    least = edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    moved = edges.join(least, edges.u == least.x).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("x", "m")).distinct()
