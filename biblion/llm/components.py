"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblion.session import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (least node of the component) of all nodes in ``edges`` (``a``, ``b``, longs).

    Each round takes the least label among a node's neighbours and then the label's own
    label; rounds grow with the logarithm of a component's length. A node of many edges
    is pre-aggregated before its minimum is shuffled. Every node is its own neighbour, so
    one join and one aggregation carry a round's labels, old and new.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(both.unionByName(both.select("a", F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(
            F.min("label").alias("least"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old")
        )
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        step = checkpoint(near.join(jump, "least").select(F.col("a").alias("node"), F.least("least", "far").alias("label"), "old"))
        if step.where("label <> old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")
