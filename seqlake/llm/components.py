"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b); label is the smallest node of the component.

    Every round each node takes the smallest label around it, and then the label of that label (pointer jumping), so that
    rounds grow with the logarithm of the longest path. Each round is written to the shared folder; nothing is collected.
    """
    spark = links.sparkSession
    both, at_edges = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph")
    label, at = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("next"))
        jump = step.join(label.select(F.col("node").alias("next"), F.col("label").alias("beyond")), "next")
        new, new_at = staged(jump.select("node", "was", F.least("next", "beyond").alias("label")), "labels")
        discard(spark, at)
        done = new.where("was <> label").isEmpty()
        label, at = new.select("node", "label"), new_at
        if done:
            discard(spark, at_edges)
            return label
