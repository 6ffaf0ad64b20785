"""Connected components over an edge table, by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, label): label is the least node reachable. Nodes without edges are absent.
    Each round lets a node take the least label among its neighbours, then the label of that label; both are written to
    shared storage, so a lost executor repeats one round at most. An empty table gives no rows."""
    spark = edges.sparkSession
    both = materialize(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("label")), "labels")
    for _ in range(most):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("_near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("label", "_near").alias("label"), F.col("label").alias("_old"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = materialize(step.join(jump, step.label == jump["_n"], "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label"), "_old"), "labels")
        done = new.where("label <> _old").isEmpty()
        release(spark, labels)
        labels = new.drop("_old")
        if done:
            return labels
    raise RuntimeError("components did not settle")
