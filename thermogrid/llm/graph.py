"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import Store


def components(edges: DataFrame, store: Store, rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``, label being the smallest node it reaches.

    Each round takes the least label among a node's neighbours, hands it to the node's old label (its root) and
    jumps to the root's new label, so the rounds grow with the logarithm of the longest path. Minima combine
    before the shuffle, and no node's neighbours are gathered in one place. A link to itself makes a node of its
    own; nulls are left out.
    """
    pairs = edges.where("a is not null and b is not null")
    both = store.put(pairs.select("a", "b").unionByName(pairs.selectExpr("b as a", "a as b")).distinct())
    labels = store.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    for _ in range(rounds):
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(around, "node", "left").select("node", "label", F.least("label", "near").alias("least"))
        met = store.put(met)
        roots = met.groupBy(F.col("label").alias("root")).agg(F.min("least").alias("top"))
        own = met.join(roots.withColumnRenamed("root", "label"), "label", "left").select("node", F.col("label").alias("before"), F.least("least", "top").alias("least"))
        after = own.join(roots.select(F.col("root").alias("least"), F.col("top").alias("far")), "least", "left")
        nxt = store.put(after.select("node", F.least("least", "far").alias("label"), "before"))
        changed = not nxt.where("label <> before").isEmpty()
        store.drop(met)
        store.drop(labels)
        labels = nxt
        if not changed:
            store.drop(both)
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
