"""Components of small graphs by shrinking labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable. Labels spread along edges and then jump to their labels' labels, until nothing changes."""
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("far"))
        now = kept(spread.join(jump, "label", "left").select("node", F.coalesce("far", "label").alias("label")))
        changed = now.join(labels.withColumnRenamed("label", "old"), "node").where("label != old").limit(1).count()
        labels = now
        if not changed:
            return labels
