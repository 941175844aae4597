"""Connected components of an edge table by minimum labels and pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node of `edges`. Nodes are longs; loops and repeated edges are fine.

    Each round takes the least label among a node and its neighbours, then the label of that label. Rounds grow with the
    logarithm of a component's diameter in practice; a round is written to the shared folder, so lost executors cost one round.
    """
    pairs = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    both = cut(pairs.union(pairs.select("y", "x")).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("root")))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("near"))
        least = labels.join(near, F.col("node") == F.col("x")).select("node", "root", F.least("root", "near").alias("low"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        after = cut(least.join(up, F.col("low") == F.col("up")).select("node", F.least("low", "top").alias("root"), (F.col("root") != F.least("low", "top")).alias("moved")))
        labels = after.select("node", "root")
        if after.where("moved").isEmpty():
            return labels
