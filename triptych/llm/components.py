"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.sources.shared import materialize


def components(links: DataFrame) -> DataFrame:
    """`node` and `root`, its component's smallest node, for each node that is not a root itself.

    `links` has the columns `u` and `v`. In each round every node hooks to its smallest
    neighbour below it, two hooks are taken at once, and the links are drawn anew between
    the nodes hooked to. A path of n nodes takes about log n rounds. Every round is written
    down, so nothing is computed again when an executor is lost; what a node sends is
    combined before the shuffle.
    """
    def ordered(frame: DataFrame) -> DataFrame:
        return frame.filter("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    left = materialize(ordered(links), "links")
    labels = None
    while not left.isEmpty():
        hooks = left.groupBy("u").agg(F.min("v").alias("p"))
        further = hooks.select(F.col("u").alias("w"), F.col("p").alias("q"))
        hooks = materialize(hooks.join(further, F.col("p") == F.col("w"), "left").select(
            "u", F.coalesce("q", "p").alias("p")), "hooks")
        if labels is None:
            labels = hooks.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = labels.join(hooks, F.col("root") == F.col("u"), "left").select(
                "node", F.coalesce("p", "root").alias("root"))
            fresh = hooks.join(labels, F.col("u") == F.col("node"), "left_anti").select(
                F.col("u").alias("node"), F.col("p").alias("root"))
            labels = materialize(moved.union(fresh), "labels")
        for end in ("u", "v"):
            hook = hooks.select(F.col("u").alias("h"), "p")
            left = left.join(hook, F.col(end) == F.col("h"), "left").withColumn(
                end, F.coalesce("p", end)).drop("h", "p")
        left = materialize(ordered(left), "links")
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
