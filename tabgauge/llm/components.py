"""Connected components of an edge list, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) from ``a, b``.

    Each round every node takes the smallest label among its neighbours and itself, then
    the label of that label. Both sides of each join are read from files, so that Spark
    can split a node with very many edges; minima are taken per task before the shuffle.
    Labels are written in the shared folder after each round.
    """
    both = shared.written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges"
    )
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = shared.written(least.select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        low = shared.written(near.union(labels).groupBy("node").agg(F.min("component").alias("component")), "labels")
        up = low.select(F.col("node").alias("component"), F.col("component").alias("next"))
        old = labels.select("node", F.col("component").alias("old"))
        after = low.join(up, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        now = shared.written(after.join(old, "node").select("node", "component", (F.col("component") != F.col("old")).alias("moved")), "labels")
        labels = now.select("node", "component")
        if not now.filter("moved").limit(1).count():
            return labels
