"""Connected components of a link table, as Spark joins.

Labels are the smallest node reached; each round takes the smallest label among the
neighbours and then jumps to the label's own label, so that paths shorten at least by
half.  Nothing is collected but the number of labels that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; ``component`` is the
    smallest node of the component.  No links: no rows."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        told = both.join(labels.withColumnRenamed("node", "b"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        lower = labels.join(told, "node") \
            .select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = materialize(lower.join(jump, "component", "left").select(
            "node", "old", F.least("component", "next").alias("component")), "labels")
        changed = labels.where(F.col("old") != F.col("component")).limit(1).count()
        labels = labels.select("node", "component")
        if not changed:
            return labels
