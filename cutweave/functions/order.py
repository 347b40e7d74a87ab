"""Order over many rows in two levels, so that no window holds them all: inside blocks of neighbouring values, then over the blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65536


def successor(rows: DataFrame, keys: list[str], at: str, width: int = WIDTH) -> DataFrame:
    """Rows with __next, the next larger value of the integer column `at` among those of equal `keys` (null: none), and __first, the smallest.

    Values of `at` are distinct within equal keys.
    """
    rows = rows.withColumn("__block", F.floor(F.col(at) / width))
    inside = Window.partitionBy(*keys, "__block").orderBy(at)
    starts = rows.groupBy(*keys, "__block").agg(F.min(at).alias("__low"))
    over = Window.partitionBy(*keys)
    starts = starts.withColumn("__after", F.lead("__low").over(over.orderBy("__block"))).withColumn("__first", F.min("__low").over(over)).drop("__low")
    rows = rows.withColumn("__next", F.lead(at).over(inside)).join(starts, [*keys, "__block"])
    return rows.withColumn("__next", F.coalesce("__next", "__after")).drop("__block", "__after")


def ranked(rows: DataFrame, at: str, width: int = WIDTH, weight: Column | None = None) -> DataFrame:
    """Rows with __before, the number of rows (or the sum of `weight`) with a smaller value of the integer column `at`."""
    rows = rows.withColumn("__block", F.floor(F.col(at) / width)).withColumn("__w", F.lit(1) if weight is None else weight)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = earlier(Window.partitionBy("__block").orderBy(at))
    blocks = rows.groupBy("__block").agg(F.sum("__w").alias("__n"))
    blocks = blocks.withColumn("__base", F.coalesce(F.sum("__n").over(earlier(Window.orderBy("__block"))), F.lit(0))).drop("__n")
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__w").over(inside), F.lit(0))).join(blocks, "__block")
    return rows.withColumn("__before", (F.col("__base") + F.col("__inside")).cast("long")).drop("__block", "__w", "__inside", "__base")
