"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst) long -> (id, component) for every node of a non-loop edge; component is the smallest id reached.

    Every node joins its smallest neighbour, chains are shortened, edges are relabelled; nodes that are no local minimum disappear in
    each round, so few rounds are needed. Neighbourhoods are reduced to their minimum before the shuffle; no group of edges or
    nodes is ever gathered in one task or on the driver.
    """
    edges = scratch.write(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("dst", "src"))
        up = scratch.write(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("to")).select("id", F.least("id", "to").alias("to")))
        for _ in range(2):
            higher, low = up.select(F.col("id").alias("via"), F.col("to").alias("top")), up
            up = scratch.write(up.join(higher, F.col("to") == F.col("via"), "left").select("id", F.coalesce("top", "to").alias("to")))
            scratch.drop(low)
        last = labels
        if last is None:
            step = up.withColumnRenamed("to", "component")
        else:
            onward = up.select(F.col("id").alias("at"), "to")
            step = last.join(onward, F.col("component") == F.col("at"), "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = scratch.write(step)
        a, b, done = up.toDF("src", "a"), up.toDF("dst", "b"), edges
        edges = scratch.write(edges.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        scratch.drop(up, done, *([last] if last is not None else []))
    return labels if labels is not None else edges.toDF("id", "component")
