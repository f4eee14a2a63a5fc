"""Connected components of an edge table by smallest neighbour labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a long, b long); the label is the smallest node of the component.

    Every round is written in the shared folder; rounds grow with the logarithm of a component's
    diameter. Only a count of changes reaches the driver.
    """
    pairs = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stored(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        seen = pairs.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        better = stored(better)
        jump = better.select(F.col("node").alias("label"), F.col("label").alias("further"))
        now = stored(better.join(jump, "label").select("node", F.least("label", "further").alias("label"), "old"))
        changed = now.filter("label <> old").limit(1).count()
        labels = now.select("node", "label")
        if not changed:
            return labels
