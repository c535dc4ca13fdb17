"""Connected components by hooking to the smallest neighbour and pointer jumping; all state is in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (long). Gives node, comp for every node that has an edge; comp is its component's smallest node.

    Each round hooks every node to its smallest neighbour if that is smaller, collapses the resulting trees by
    pointer jumping (log of their depth), and goes on with the edges between different trees.
    """
    left = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "up")
        while True:
            above = up.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            jumped = scratch.keep(up.join(above, "comp").select("node", F.col("top").alias("comp"), (F.col("top") != F.col("comp")).alias("moved")), "up")
            done = jumped.where("moved").isEmpty()
            up = jumped.drop("moved")
            if done:
                break
        if labels is None:
            labels = up
        else:
            new = up.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            labels = scratch.keep(labels.join(new, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")
        a, b = (up.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
        left = scratch.keep(left.join(a, "a").join(b, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).where("a < b").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).where("false")
