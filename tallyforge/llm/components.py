"""Connected components by contraction: each node is merged into its smallest neighbour until no edge is left.

Every round is a few joins and sums over the edges still between different nodes, written to the shared folder; the
number of rounds grows with the logarithm of the longest chain. Nothing is collected but counts of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame, where: str) -> DataFrame:
    """node and label (smallest node it is connected with) for each node of the edges (a, b)."""
    rest = common.written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{where}/edges-0")
    labels, step = None, 0
    while step == 0 or not rest.isEmpty():
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).union(rest.select("b", "a"))
        parents = common.written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")), f"{where}/parents-{step}")
        of_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = rest.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        step += 1
        rest = common.written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{where}/edges-{step}")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            up = parents.select(F.col("node").alias("label"), "parent")
            labels = labels.join(up, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
        labels = common.written(labels, f"{where}/labels-{step}")
    return labels
