"""Connected components of an edge table, by labels that only shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): ``component`` is the smallest node that ``node`` reaches.

    Nodes without an edge are not listed; null ends and self-loops are ignored.
    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so long chains shorten by doubling. Rounds are written
    to the shared folder, each in place of the one before; only whether one is the
    last reaches the driver.
    """
    pairs = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    both = settle(pairs.union(pairs.select("dst", "src")).distinct(), "edges")
    labels = settle(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        onward = labels.select(F.col("node").alias("step"), F.col("label").alias("jump"))
        new = stepped.join(onward, "step").select("node", F.least("step", "jump").alias("label"), (F.least("step", "jump") < F.col("old")).alias("moved"))
        new = settle(new, "labels")
        discard(labels)
        labels = new
        if not new.where("moved").take(1):
            discard(both)
            return new.select("node", F.col("label").alias("component"))
