"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over the edges (a, b).

    Each round hands the smallest label seen to the neighbours, then follows labels of labels, so
    the number of rounds grows with the logarithm of the longest path. Rounds are stored, so a
    lost executor costs one round. Sums and minima are pre-aggregated before every shuffle.
    """
    both = edges.select("a", "b").where("a <> b")
    both = stored(both.union(both.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        after = stored(step.join(jump, step.label == jump.n2).select("node", F.least("label", "l2").alias("label"), "old"))
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
