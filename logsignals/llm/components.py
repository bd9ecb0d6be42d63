"""Connected components by smallest label with pointer jumping, one small table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsignals.llm.textual import saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b); label is the smallest node of its component.

    Every round takes the smallest label among a node's neighbours and then its label's label, so
    chains shorten by half. Both steps aggregate before they shuffle: a hub costs one row per task.
    """
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = saved(closer.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")))
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels
