"""Connected components of a table of links, by repeated minima and shortcuts; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.workspace import checkpoint


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Each round a node takes the least label among itself and its neighbours, then the label of that label; nodes with
    many links are combined on the map side. Rounds grow with the logarithm of the longest chain in practice.
    """
    links = links.select("a", "b").where("a <> b")
    both = checkpoint(links.union(links.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component"))
                        .withColumnRenamed("a", "node"))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a")
                .agg(F.min("component").alias("near")).withColumnRenamed("a", "node"))
        # only a lower label than the node's own matters
        taken = labels.join(near, "node").select("node", F.least("component", "near").alias("next"),
                                                 F.col("component").alias("old"))
        step = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        taken = checkpoint(taken.join(step, "next", "left").select(
            "node", F.least("next", F.coalesce("further", "next")).alias("component"), "old"))
        labels = taken.select("node", "component")
        if taken.where("component <> old").isEmpty():
            return labels
