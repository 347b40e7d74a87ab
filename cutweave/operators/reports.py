"""Reports over measurement logs and grids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round_half_up
from ..functions.order import ranked
from ..functions.scratch import Scratch
from ..sources.generators import density_cells, grid, random_graph
from .bonds import bonds

T = TypeVar("T")


def path_length_profile(log: DataFrame) -> DataFrame:
    """Mean length by stage and level; lengths of 0 only show that the group exists (null mean if there are no others)."""
    return log.groupBy("stage", "level").agg(F.avg(F.when(F.col("len") != 0, F.col("len"))).alias("avg_len"))


def quartile_report(log: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Per quartile of run time: bounds, number of records and sum of bonds; a record is in the first quartile whose upper bound it does not exceed.

    Records with no time and no bonds are left out unless keep_zero.
    """
    rows = log if keep_zero else log.where("ms <> 0 OR bonds <> 0")
    # exact quartiles from counts per value: the values around each place, and a straight line between them
    counts = ranked(rows.groupBy("ms").agg(F.count("*").alias("n")), "ms", weight=F.col("n"))
    total = rows.agg(F.count("*").alias("total"))
    place = (F.col("total") - 1) * F.col("q") / 4
    places = total.where("total > 0").select(F.explode(F.array(*[F.lit(q) for q in range(5)])).alias("q"), "total")
    places = places.select("q", F.floor(place).alias("lower"), F.ceil(place).alias("upper"), (place - F.floor(place)).alias("part"))
    around = counts.join(F.broadcast(places), (F.col("upper") >= F.col("__before")) & (F.col("lower") < F.col("__before") + F.col("n")))
    holds = lambda c: F.max(F.when((F.col(c) >= F.col("__before")) & (F.col(c) < F.col("__before") + F.col("n")), F.col("ms").cast("double")))
    bounds = around.groupBy("q", "part").agg(holds("lower").alias("a"), holds("upper").alias("b")).withColumn("at", F.col("a") + F.col("part") * (F.col("b") - F.col("a")))
    marks = bounds.agg(F.array_sort(F.collect_list(F.struct("q", "at"))).alias("b")).select(F.when(F.size("b") > 0, F.transform("b", lambda x: x["at"])).alias("b"))  # five rows
    binned = rows.crossJoin(F.broadcast(marks)).withColumn("q", F.when(F.col("ms") <= F.get("b", 1), 0).when(F.col("ms") <= F.get("b", 2), 1).when(F.col("ms") <= F.get("b", 3), 2).otherwise(3))
    sums = binned.groupBy("q").agg(F.count("*").alias("n"), F.sum("bonds").alias("s"))
    bins = marks.where("b IS NOT NULL").select("b", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    out = bins.join(sums, "q", "left")
    return out.select(F.col("q").alias("quartile"), F.get("b", F.col("q")).alias("low"), F.get("b", F.col("q") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("records"), F.coalesce("s", F.lit(0)).alias("bonds"))


def noncanonicity_percent(rows: DataFrame) -> DataFrame:
    return rows.select("k", "m", round_half_up(F.col("noncan") / F.col("can") * 100 - 100, 3).alias("percent"))


def pivot_table(rows: DataFrame, value: str, max_m: int | None = None) -> DataFrame:
    """A row per k, a column per m from 1 to the largest; the number of columns is the size bound of the grid."""
    top = max_m or rows.agg(F.max("m")).first()[0] or 0
    return rows.groupBy("k").pivot("m", list(range(1, top + 1))).agg(F.first(value))


def cpu_seconds(spark: SparkSession, work: Callable[[], T]) -> tuple[T, float]:
    """What work() gives, and the CPU seconds that executors of this application spent in the JVM meanwhile (Python workers not counted)."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def spent() -> float:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).executorCpuTime() for i in range(stages.size())) / 1e9

    before = spent()
    out = work()
    return out, spent() - before


def km_grid(edges: DataFrame, m: tuple[int, int], k: tuple[int, int]) -> DataFrame:
    """(k, m, secs, bonds) of enumerating each cell; seconds are CPU seconds of executors."""
    spark, out = edges.sparkSession, []
    for cell in grid(spark, m, k).collect():  # a row per cell, not per edge
        n, secs = cpu_seconds(spark, lambda cell=cell: bonds(edges, cell.m, cell.k).count())
        out.append((cell.k, cell.m, secs, n))
    return spark.createDataFrame(out, "k int, m int, secs double, bonds long")


def km_counts(edges: DataFrame, m: int, k: tuple[int, int]) -> DataFrame:
    """(k, m, bonds) for all bounds up to m from one enumeration."""
    found = bonds(edges, m, f"{k[0]}-{k[1]}").select("k", F.size("edges").alias("size"))
    cells = grid(edges.sparkSession, (1, m), k)
    return cells.join(found, (cells.k == found.k) & (found["size"] <= cells.m), "left").groupBy(cells.k, cells.m).agg(F.count("size").alias("bonds"))


def derivations(edges: DataFrame, m: int, k: tuple[int, int]) -> DataFrame:
    """(k, m, noncan, can): how many chains of successive splits lead to k-bonds of at most m edges, and how many k-bonds there are.

    A chain is a 2-bond of the graph, then a 2-bond of what it leaves, and so on, the smallest edges of its steps rising: what a search that
    splits one component after the other writes, duplicates included. The sets that it passes are bonds of one part more each time, so chains
    are counted level by level: a bond is joined with the bonds of the level before that lie inside it, which meet it in their smallest edge.
    """
    scratch = Scratch(edges.sparkSession)
    found = scratch.write(bonds(edges, m, f"2-{k[1]}"))
    first = found.where("k = 2").select("edges", F.array_min("edges").alias("last"), F.lit(1).cast("long").alias("n"))
    chains, counted = scratch.write(first), []
    for level in range(2, k[1] + 1):
        if level > 2:
            wider = found.where(F.col("k") == level).select(F.col("edges").alias("to"), F.explode("edges").alias("at"))
            inside = wider.join(chains.withColumn("at", F.array_min("edges")), "at").where(F.size(F.array_except("edges", "to")) == 0)
            step = F.array_min(F.array_except("to", "edges"))
            grown = inside.withColumn("least", step).where("least > last").groupBy(F.col("to").alias("edges"), F.col("least").alias("last"))
            chains = scratch.write(grown.agg(F.sum("n").alias("n")))
        counted.append(chains.groupBy(F.lit(level).alias("k"), F.size("edges").alias("size")).agg(F.sum("n").alias("noncan")))
    chain_sizes = reduce(DataFrame.union, counted)
    sizes = found.groupBy("k", F.size("edges").alias("size")).agg(F.count("*").alias("can")).join(chain_sizes, ["k", "size"], "left")
    cells = grid(edges.sparkSession, (3, m), k, lead=0).withColumnsRenamed({"k": "ck", "m": "cm"})
    both = cells.join(sizes, (F.col("ck") == F.col("k")) & (F.col("size") <= F.col("cm")), "left").groupBy("ck", "cm")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return both.agg(total("noncan"), total("can")).toDF("k", "m", "noncan", "can")


def density_grid(spark, n: int, max_edges: int, trials: int, m: int, k: int, seed: int = 0) -> DataFrame:
    """(n_edges, trial, ms, bonds) on random graphs, a run per cell; ms are CPU milliseconds of executors."""
    out = []
    for cell in density_cells(spark, n, max_edges, trials).collect():
        graph = random_graph(spark, n, cell.n_edges, cell.n_edges, seed=seed * 1_000_003 + cell.n_edges * 1009 + cell.trial)
        found, secs = cpu_seconds(spark, lambda graph=graph: bonds(graph, m, k).count())
        out.append((cell.n_edges, cell.trial, int(secs * 1000), found))
    return spark.createDataFrame(out, "n_edges int, trial int, ms long, bonds long")
