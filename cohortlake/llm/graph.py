"""Connected components of a table of links, as Spark jobs over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``links`` (a, b): the smallest node that can be reached.

    Each round takes the smallest label among neighbours, then the label of that label, so paths halve. Labels are
    aggregated before the shuffle; a node with very many links is split over tasks by the adaptive join.
    """
    edges = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        labels = materialise(labels, "labels")
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = materialise(step.join(of, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if step.where("old <> label").isEmpty():
            return step.select("node", F.col("label").alias("component"))
        labels = step.select("node", "label")
