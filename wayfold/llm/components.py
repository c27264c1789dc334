"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's least node.

    Each round takes the least label among a node's neighbours and then the label of that label, so that a component's
    diameter is halved.  Labels are written every round; joins are between freshly shuffled sides, so Spark can split a
    hub's partition.
    """
    #: a node's edges to many smaller ones become edges to the least of them, which leaves components as they are
    ends = materialize(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "ends")
    least = ends.groupBy("high").agg(F.min("low").alias("least"))
    ends = ends.join(least, "high")
    edges = ends.select(F.col("high").alias("a"), F.col("least").alias("b")).union(ends.select("low", "least")).filter("a <> b")
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    for _ in range(rounds):
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("offer"))
        better = labels.join(offered, labels["node"] == offered["a"], "left").select("node", F.col("root").alias("before"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        better = materialize(better, "hooked")
        up = better.select(F.col("node").alias("at"), F.col("root").alias("above"))
        labels = materialize(better.join(up, better["root"] == up["at"]).select("node", F.least("root", "above").alias("root"), "before"), "labels")
        if labels.filter("root <> before").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
    raise RuntimeError(f"labels still change after {rounds} rounds")
