"""Connected components of an edge table, in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def components(edges: DataFrame, left: str = "x", right: str = "y") -> DataFrame:
    """Per node of an edge: ``node`` and ``label``, the smallest node that it reaches.

    Each round gives a node the least label around it and then that label's own label, so that the
    number of rounds grows with the logarithm of a component's width. Labels are written after each
    round. The least label is combined before the shuffle, so a node of many edges is no hot group.
    """
    one = edges.select(F.col(left).alias("x"), F.col(right).alias("y"))
    both = stored(one.union(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least"))
    labels = stored(labels.select("node", F.least("node", "least").alias("label"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        around = (
            both.join(labels, both["x"] == labels["node"]).groupBy(F.col("y").alias("node")).agg(F.min("label").alias("near"))
        )
        nearer = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("next"))
        step = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        nearer = nearer.join(step, "next").select("node", "label", F.least("next", "jump").alias("next"))
        labels = stored(nearer.select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")))
    return labels.select("node", "label")
