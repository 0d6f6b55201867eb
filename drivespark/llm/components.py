"""Connected components by label propagation with pointer jumping, all of it in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; ``label`` is one node of its component, the same for all of it.

    Stars are taken together first: a node ``a`` leaves only its smallest neighbour ``m`` and links from its other
    neighbours to ``m``, so in a large group, where all nodes point to a few, the rounds run over those few. Nulls, loops
    and repeated edges change nothing.
    """
    e = staged(edges.select("a", "b").where("a <> b").distinct())
    first = staged(e.groupBy("a").agg(F.min("b").alias("m")))
    heads = e.select("b").distinct()
    between = e.join(first, "a").where("b <> m").select("b", "m").distinct()
    kept = first.join(heads.withColumnRenamed("b", "a"), "a", "left_semi").select(F.col("a").alias("b"), "m")
    labels = propagated(between.unionByName(kept))
    of = lambda d, node: d.join(labels.withColumnRenamed("node", node), node, "left").select("node", F.coalesce("label", node).alias("label"))
    leaves = first.join(heads.withColumnRenamed("b", "a"), "a", "left_anti").select(F.col("a").alias("node"), "m")
    return of(leaves, "m").unionByName(of(heads.select("b", F.col("b").alias("node")), "b"))


def propagated(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(b, m)``: label is the smallest node that it is linked to, itself included.

    Each round takes the smallest label next to a node, then the label of that label, until nothing changes, so the
    rounds grow with the logarithm of a chain's length. Every round is written to the shared folder; only the count of
    changed nodes reaches the driver.
    """
    e = edges.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    e = staged(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("new"))
        heads = labels.select(F.col("node").alias("new"), F.col("label").alias("head"))
        after = staged(step.join(heads, "new").select("node", "old", F.least("new", "head").alias("label")))
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
