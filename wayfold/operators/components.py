"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b), the root being the component's least node.

    A round takes the least root among a node and its neighbours, then that root's own root, until nothing changes.  Before that
    a node's edges to many lesser ones become edges to the least of them, which leaves components as they are.
    """
    ends = cut_lineage(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "ends")
    low = ends.join(ends.groupBy("high").agg(F.min("low").alias("least")), "high")
    edges = low.select(F.col("high").alias("a"), F.col("least").alias("b")).union(low.select("low", "least")).filter("a <> b").union(ends.filter("low = high"))
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root"))
    roots = cut_lineage(roots, "roots")
    for _ in range(rounds):
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("offer"))
        step = cut_lineage(roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "offer").alias("root")), "step")
        above = step.select(F.col("node").alias("at"), F.col("root").alias("above"))
        roots = cut_lineage(step.join(above, step["root"] == above["at"]).select("node", F.least("root", "above").alias("root"), "old"), "roots")
        if roots.filter("root <> old").isEmpty():
            return roots.select("node", "root")
        roots = roots.select("node", "root")
    raise RuntimeError("roots did not settle")
