"""Connected components by repeated contraction, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each round renames every node to its smallest neighbour and keeps the edges that still join two names.
    Stars vanish in one round and chains shrink by half or better. The minimum of a hub's neighbours is taken
    before the shuffle, and every round is written, so nothing is recomputed.
    """
    left = edges.select("a", "b").filter("a <> b").distinct()
    left = scratch.save(left, f"{name}-edges0")
    labels, n = None, 0
    while labels is None or not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        least = both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("to"))
        least = scratch.save(least, f"{name}-least{n}")
        if labels is None:
            labels = least.select("node", F.col("to").alias("component"))
        else:
            step = least.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = scratch.save(labels, f"{name}-labels{n}")
        renamed = (
            left.join(least.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(least.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        n += 1
        left = scratch.save(renamed, f"{name}-edges{n}")
    return labels
