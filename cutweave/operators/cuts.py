"""Operators on cut tables (line_no, edges): canonical forms, set algebra, verification, sampling, id and name lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_bag, as_set, gf2_rank, has_coloop
from ..functions.order import ranked
from ..functions.scratch import Scratch
from . import small
from .graph import is_small, labelled

def cut_uniq(cuts: DataFrame) -> DataFrame:
    """Distinct cuts as sorted bags (repeated ids inside a cut stay, empty cuts go): edges, size. Present by (size, edges)."""
    return cuts.select(as_bag(F.col("edges")).alias("edges")).where(F.size("edges") > 0).distinct().withColumn("size", F.size("edges"))


def by_size(cuts: DataFrame) -> DataFrame:
    return cuts.orderBy(F.size("edges"), "edges")


def cut_sets(cuts: DataFrame) -> DataFrame:
    return cuts.select(as_set(F.col("edges")).alias("edges")).distinct()


def cut_diff(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Cuts of `left` that are not in `right`, both as sets of sets; without `right`, all of `left`."""
    return cut_sets(left) if right is None else cut_sets(left).join(cut_sets(right), "edges", "left_anti")


def cut_symdiff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, edges): what only `left` (A) and only `right` (B) has."""
    return cut_diff(left, right).select(F.lit("A").alias("side"), "edges").union(cut_diff(right, left).select(F.lit("B"), "edges"))


def combinations(edges: DataFrame, size: int) -> DataFrame:
    """Every set of `size` edges as a sorted array, by joins on increasing ids."""
    out = edges.select(F.array("id").alias("edges"))
    for _ in range(size - 1):
        out = out.join(edges.select("id"), F.element_at("edges", -1) < F.col("id")).select(F.concat("edges", F.array("id")).alias("edges"))
    return out


def _ranked(labels: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cuts with the labels of their (distinct) ids and their unknown ids; a cut is its line_no and edges."""
    keyed = cuts.select("line_no", "edges")
    members = keyed.select("line_no", "edges", F.explode_outer(F.array_distinct("edges")).alias("id")).distinct()
    # a row per distinct cut first, so that equal lines are worked out once
    found = members.join(labels.select("id", "label"), "id", "left").groupBy("line_no", "edges").agg(
        F.collect_list("label").alias("labels"), F.collect_list(F.when(F.col("id").isNotNull() & F.col("label").isNull(), F.col("id"))).alias("unknown_ids")
    )
    return found.withColumn("nullity", F.size("labels") - gf2_rank(F.col("labels")))


def check_cuts(edges: DataFrame, cuts: DataFrame, seed: int = 0) -> DataFrame:
    """(line_no, edges, n_components, status, unknown_ids); status: true, false_not_cut, false_not_minimal or unknown_edge.

    Needs no traversal per cut: with labels of GF(2) rank r, removing C leaves components(G) + |C| - r components, and C is minimal if no
    label lies outside all dependencies. The empty cut of a disconnected graph is minimal.
    """
    labels = Scratch(edges.sparkSession).write(labelled(edges, seed).select("id", "label", "base"))
    base = labels.agg(F.coalesce(F.max("base"), F.lit(0)).alias("base"))
    found = _ranked(labels, cuts).crossJoin(F.broadcast(base)).withColumn("n_components", (F.col("base") + F.col("nullity")).cast("int"))
    status = (
        F.when(F.size("unknown_ids") > 0, "unknown_edge").when(F.col("n_components") == 1, "false_not_cut").when(has_coloop(F.col("labels")), "false_not_minimal").otherwise("true")
    )
    return found.select("line_no", "edges", F.when(F.size("unknown_ids") == 0, F.col("n_components")).alias("n_components"), status.alias("status"), "unknown_ids")


def components_after(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    return check_cuts(edges, cuts).select("line_no", "edges", "n_components")


def fold_check(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (edges, ...) with k, the number of components left, and whether all their edges separate; by the definition, without labels.

    The graph goes to every task, so it may have LOCAL_EDGES edges at most (some 12 MB), which is checked.
    """
    if not is_small(edges):
        raise ValueError(f"the check by definition needs a graph of at most {small.LOCAL_EDGES} edges; use the label-based operators")
    rows = edges.select("id", "src", "dst").toPandas()
    graph = edges.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("id", "src", "dst")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker = small.CutChecker(*graph.value)
        for batch in batches:
            found = [checker.check(c) for c in batch["edges"].to_pylist()]
            added = [pa.array([k for k, _ in found], pa.int32()), pa.array([s for _, s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "k", "separates"])

    added = [T.StructField("k", T.IntegerType()), T.StructField("separates", T.BooleanType())]
    return candidates.mapInArrow(run, T.StructType([*candidates.schema.fields, *added]))


def stride_sample(cuts: DataFrame, target: int = 5000) -> DataFrame:
    """With n >= target cuts, those whose position is divisible by n div target; all otherwise. Positions are ranks of line_no.

    Ranks are counted in blocks of line numbers, so that no window holds all rows.
    """
    n = cuts.count()
    step = max(1, n // target)
    return ranked(cuts, "line_no").where(F.col("__before") % step == 0).select(cuts.columns)


def first_failure(checked: DataFrame) -> DataFrame:
    return checked.where("status <> 'true'").orderBy("line_no").limit(1)


def fail_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if(F.col("status") != "true").alias("fails"), F.count("*").alias("total"))


def ids_to_edges(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """(line_no, pos, id, src, dst): the edges of each cut in order; an unknown id has null ends."""
    return cuts.select("line_no", F.posexplode("edges").alias("pos", "id")).join(edges.select("id", "src", "dst"), "id", "left").select("line_no", "pos", "id", "src", "dst")


def names_to_ids(names: DataFrame, lists: DataFrame) -> DataFrame:
    """(line_no, edges): names (id, name, and line_no if a name may come twice: the last wins) looked up for lists (line_no, names).

    A name that is not in the table raises.
    """
    key = F.struct("line_no", "id") if "line_no" in names.columns else F.struct("id")
    known = names.groupBy("name").agg(F.max_by("id", key).alias("id"))
    rows = lists.select("line_no", F.posexplode_outer("names").alias("pos", "name")).join(known, "name", "left")
    found = F.when(F.col("name").isNotNull() & F.col("id").isNull(), F.raise_error(F.concat(F.lit("unknown name: "), "name"))).otherwise(F.col("id"))
    rows = rows.withColumn("id", found).groupBy("line_no")
    pairs = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id"))))
    return rows.agg(F.transform(pairs, lambda x: x["id"]).alias("edges"))


def leave_one_out(cuts: DataFrame) -> DataFrame:
    """(line_no, restored, edges): each cut without one of its ids."""
    return cuts.select("line_no", F.explode(F.array_distinct("edges")).alias("restored"), "edges").select("line_no", "restored", F.expr("array_remove(edges, restored)").alias("edges"))


def size_counts(cuts: DataFrame, size: Column | None = None) -> DataFrame:
    return cuts.groupBy((F.size("edges") if size is None else size).alias("size")).agg(F.count("*").alias("n"))
