"""Connected components of a graph given as edges, with DataFrame operations only.

Large-star and small-star steps alternate until every edge leads to a node without an edge of its own,
which is then the smallest node of its component. Each step pre-aggregates by node, so that a node with very many
edges does not meet in one task, and its result is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with one edge to a node with none: then all point at their smallest."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (columns a and b); component is its smallest node."""
    now = durable(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(now):
        now = durable(_small_star(_large_star(now)))
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (what ``components`` returned) with the components joined by ``links`` (a, b), which lead from component to component or to nodes that have none yet."""
    moved = durable(components(links))
    renamed = known.join(moved.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return renamed.unionByName(moved.join(known, "node", "left_anti"))
