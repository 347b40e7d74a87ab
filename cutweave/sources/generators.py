"""Graphs to test on: random simple connected graphs, all small connected graphs, parameter grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.order import ranked
from ..functions.scratch import Scratch
from ..operators.graph import make_connected
from ..operators.small import component_map

#: 2^28 masks of pairs; one node more would make 2^36.
MAX_ENUMERATED = 8


def _draw(text: Column) -> Column:
    """A number of 60 bits from the MD5 of a text, the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def random_graph(spark: SparkSession, n: int, min_edges: int, max_edges: int, seed: int = 0, connected: bool = True) -> DataFrame:
    """A simple graph on 0..n-1 with a number of edges drawn from [min_edges, max_edges]; links added for connection may exceed it.

    Pairs of nodes are numbered (0,1), (0,2), (1,2), (0,3), ...; the i-th draw is a pair number from MD5 of "seed/i", and the pairs that come up first are
    the edges. Of more than half of all pairs, those that are no edges are drawn instead. A seed gives one graph anywhere.
    """
    pairs = n * (n - 1) // 2
    if not 0 <= min_edges <= max_edges <= pairs:
        raise ValueError("there are not that many pairs of nodes")
    wanted = min_edges + spark.range(1).select(_draw(F.lit(f"{seed}/edges")) % (max_edges - min_edges + 1)).first()[0]
    few, draws = min(wanted, pairs - wanted), 0
    drawn = spark.range(0).select(F.col("id").alias("pair"), F.col("id").alias("nth"))
    while few and (not draws or drawn.count() < few):
        draws = 2 * draws or 2 * few + 64
        drawn = spark.range(draws).select((_draw(F.concat(F.lit(f"{seed}/"), F.col("id").cast("string"))) % pairs).alias("pair"), F.col("id").alias("nth"))
        drawn = drawn.groupBy("pair").agg(F.min("nth").alias("nth"))
    drawn = ranked(drawn, "nth").where(F.col("__before") < few).select("pair", F.col("__before").alias("id"))
    if few < wanted:
        drawn = ranked(spark.range(pairs).withColumnRenamed("id", "pair").join(drawn.select("pair"), "pair", "left_anti"), "pair").select("pair", F.col("__before").alias("id"))
    dst = F.floor((F.sqrt(F.col("pair") * 8 + 1) + 1) / 2)
    rows = drawn.select(F.col("id").cast("int").alias("id"), (F.col("pair") - dst * (dst - 1) / 2).cast("int").alias("src"), dst.cast("int").alias("dst"))
    rows = Scratch(spark).write(rows)
    if not connected:
        return rows
    everything = spark.range(n).select(F.col("id").cast("int").alias("node"))
    return rows.union(make_connected(rows, everything))


def random_graphs(spark: SparkSession, count: int, n: int, min_edges: int, max_edges: int, seed: int = 0) -> DataFrame:
    """(graph_id, id, src, dst): `count` small simple connected graphs on 0..n-1, each as random_graph() would have it, but by the smallest MD5 of its pairs."""
    pairs = n * (n - 1) // 2
    if not 1 <= min_edges <= max_edges <= pairs:
        raise ValueError("there are not that many pairs of nodes")
    name = lambda what: F.concat(F.lit(f"{seed}/"), F.col("graph_id").cast("string"), F.lit("/"), what)
    graphs = spark.range(count).select(F.col("id").alias("graph_id"))
    graphs = graphs.withColumn("wanted", min_edges + _draw(name(F.lit("edges"))) % (max_edges - min_edges + 1)).withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    order = Window.partitionBy("graph_id").orderBy(F.md5(name(F.col("pair").cast("string")).cast("binary")), "pair")
    dst = F.floor((F.sqrt(F.col("pair") * 8 + 1) + 1) / 2)
    rows = graphs.withColumn("id", F.row_number().over(order) - 1).where("id < wanted")
    rows = rows.select("graph_id", "id", (F.col("pair") - dst * (dst - 1) / 2).cast("int").alias("src"), dst.cast("int").alias("dst"))

    def connected(pdf: pd.DataFrame) -> pd.DataFrame:
        component = dict.fromkeys(range(n)) | dict(component_map(pdf).itertuples(index=False))
        ends = sorted({v if c is None else c for v, c in component.items()})
        links = [(pdf["graph_id"].iloc[0], len(pdf) + i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
        return pd.concat([pdf, pd.DataFrame(links, columns=list(pdf.columns))]).astype("int64")

    return rows.groupBy("graph_id").applyInPandas(connected, "graph_id long, id int, src int, dst int")


def street_grid(spark: SparkSession, width: int, height: int, gone: int = 40, dead_ends: int = 15, seed: int = 0) -> DataFrame:
    """A graph like a town's streets: a grid of crossings without about `gone` percent of its sides, dead ends at `dead_ends` percent of the crossings.

    What MD5 of "seed/edge" draws stays away; parts that come loose stay, so that the graph may have several components. Ids count up along the grid.
    """
    name = lambda what: F.concat(F.lit(f"{seed}/{what}/"), F.col("id").cast("string"))
    at = spark.range(width * height)
    right = at.where((F.col("id") + 1) % width != 0).select((F.col("id") * 3).alias("id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = at.where(F.col("id") < width * (height - 1)).select((F.col("id") * 3 + 1).alias("id"), F.col("id").alias("src"), (F.col("id") + width).alias("dst"))
    sides = right.union(down).where(_draw(name("side")) % 100 >= gone)
    ends = at.where(_draw(name("end")) % 100 < dead_ends).select((F.col("id") * 3 + 2).alias("id"), F.col("id").alias("src"), (F.col("id") + width * height).alias("dst"))
    return sides.union(ends).select(*[F.col(c).cast("int").alias(c) for c in ("id", "src", "dst")])


def all_connected_graphs(spark: SparkSession, n: int) -> DataFrame:
    """(graph_id, id, src, dst): every labelled connected graph on n nodes; graph_id is the bit mask of its pairs in column order."""
    if not 2 <= n <= MAX_ENUMERATED:
        raise ValueError(f"n must lie in 2..{MAX_ENUMERATED}")
    pairs = [(i, j) for j in range(n) for i in range(j)]
    array = F.array(*[F.struct(F.lit(b).alias("id"), F.lit(i).alias("src"), F.lit(j).alias("dst")) for b, (i, j) in enumerate(pairs)])
    masks = spark.range(1 << len(pairs)).select(F.col("id").alias("graph_id"))
    masks = masks.withColumn("edges", F.filter(array, lambda e: F.floor(F.col("graph_id") / F.pow(F.lit(2), e["id"])).cast("long") % 2 == 1))
    start = F.array(*[F.lit(i) for i in range(n)])
    label = F.aggregate("edges", start, lambda m, e: F.transform(m, lambda c: F.when(c == F.get(m, e["src"]), F.get(m, e["dst"])).otherwise(c)))
    return masks.where(F.size(F.array_distinct(label)) == 1).select("graph_id", F.inline("edges"))


def grid(spark: SparkSession, m: tuple[int, int], k: tuple[int, int], lead: int = 1) -> DataFrame:
    """(k, m) cells with m at least k - lead: lead 1 for run times, 0 for duplicates."""
    ks = spark.range(k[0], k[1] + 1).select(F.col("id").cast("int").alias("k"))
    return ks.select("k", F.explode(F.when(F.greatest(F.lit(m[0]), F.col("k") - lead) <= m[1], F.sequence(F.greatest(F.lit(m[0]), F.col("k") - lead), F.lit(m[1])))).alias("m"))


def density_cells(spark: SparkSession, n: int, max_edges: int, trials: int) -> DataFrame:
    """(n_edges, trial) with n_edges from n to max_edges."""
    return spark.range(n, max_edges + 1).select(F.col("id").cast("int").alias("n_edges"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
