"""Embedding near-duplicates by an exact metric range join.

Vectors of one label become unit vectors; cosine >= c is a distance of at most r = sqrt(2 - 2c). Pivots split large labels into cells:
a vector owns the cell of its nearest pivot. A vector x is replicated to the cell of another pivot p unless the triangle inequality
rules out that the cell owns a vector within r of x: if x is farther than r from the bisector of p and its own pivot, or farther than
r from the ball around p that holds the cell's own vectors. Both tests are written without divisions and differences of nearly equal
distances, with a bound on the rounding of inner products, so that pivots may lie as close as they like. Cells are then joined
independently: each own vector meets all own and replicated vectors of its cell, once. Large cells are joined block against block, so
no task holds more than two blocks.

Equal vectors of a label are one class with a count, so that copies cost nothing. Links are counted, never written as pairs; a
block gives only a spanning forest of its links, from which components are found.

The pivots (at most MAX_PIVOTS in all, a bounded sample chosen by hash, none nearer than r / 2 to another of its label) decide the cells
only; every vector is joined, and results do not depend on them. In high dimensions without clusters the bounds rule out little and a
vector is replicated to most cells of its label: the join is then a blocked comparison of all vectors of a label, still exact.

A vector that is null, empty, zero, or holds null or non-finite components, and one without label or id, links with nothing and is its
own component. Vectors of different lengths never link. Ties: a cosine equal to the threshold links. Repeated rows count each. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Scratch

CELL, BLOCK, MAX_PIVOTS = 4096, 4096, 4096


def rounding(dim: int) -> float:
    """More than what rounding adds to an inner product, or twice one, of two unit vectors."""
    return 8 * (dim + 16) * 2.0**-52


def reach(least: float, dim: int) -> float:
    """The largest distance of unit vectors whose computed cosine is at least `least`."""
    return math.sqrt(max(0.0, 2 - 2 * least) + rounding(dim))


def vector_rows(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Each valid vector as float64, None for the others; and the flags."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fine = (lengths > 0) & (bad[ends[1:]] == bad[ends[:-1]])
    return [flat[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], fine, strict=True)], fine


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label (text), unit (float64 bytes; null for vectors that take no part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in vector_rows(batch["v"])[0]:
                top = 0.0 if v is None else float(np.abs(v).max())
                if top > 0:
                    v = v / top
                    out.append((v / math.sqrt(float(v @ v)) + 0.0).tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(out, pa.binary())], ["vec_id", "label", "unit"])

    plain = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return plain.mapInArrow(run, "vec_id long, label string, unit binary")


def _matrix(column) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _pivots(classes: DataFrame, least: float) -> dict[str, np.ndarray]:
    """Pivots of the groups with more than CELL classes, their number in proportion to the group and at most MAX_PIVOTS in all."""
    large = classes.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") > CELL)
    total = large.agg(F.sum("size").alias("total")).first().total
    if not total:
        return {}
    wanted = F.least(F.ceil(F.col("size") / CELL), F.floor(F.col("size") * F.lit(MAX_PIVOTS / total)))
    large = large.withColumn("wanted", wanted.cast("int")).where("wanted > 1")
    draw = F.pmod(F.xxhash64("unit"), F.lit(1 << 30)) < F.col("wanted") * 3 / F.col("size") * (1 << 30)  # about three times as many as needed
    drawn = classes.join(F.broadcast(large), "grp").where(draw).select("grp", "unit", "wanted").limit(4 * MAX_PIVOTS).collect()
    candidates: dict[str, list] = {}
    for r in sorted(drawn, key=lambda r: (r.grp, hash_order(r.unit))):
        candidates.setdefault(r.grp, []).append(r)
    out = {g: spread(_matrix([bytes(r.unit) for r in rows]), rows[0].wanted, least) for g, rows in candidates.items()}
    return {g: p for g, p in out.items() if len(p) > 1}


def spread(points: np.ndarray, wanted: int, least: float) -> np.ndarray:
    """The first `wanted` points that are no nearer than half the query radius to one taken before: nearer cells prune nothing."""
    near, taken = 1 - reach(least, points.shape[1]) ** 2 / 8, []
    for i in range(len(points)):
        if len(taken) < wanted and not (taken and (points[taken] @ points[i]).max() > near):
            taken.append(i)
    return points[taken]


def hash_order(b: bytes) -> int:
    return int(np.bitwise_xor.reduce(np.frombuffer(b, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _own_cells(classes: DataFrame, pivots) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            groups, units = np.array(batch["grp"].to_pylist(), object), batch["unit"].to_pylist()
            for g in set(groups.tolist()) & set(pivots.value):
                at = np.flatnonzero(groups == g)
                x = _matrix([units[i] for i in at])
                cell[at] = (x @ pivots.value[g].T).argmax(1)
                far[at] = np.sqrt(((x - pivots.value[g][cell[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch["grp"], batch["unit"], batch["rep"], batch["n"], pa.array(cell), pa.array(far)], ["grp", "unit", "rep", "n", "cell", "far"])

    return classes.select("grp", "unit", "rep", "n").mapInArrow(run, "grp string, unit binary, rep long, n long, cell int, far double")


def _visited(owned: DataFrame, pivots, radii, least: float) -> DataFrame:
    """A row per cell that a class is compared in: its own and those whose own vectors may be linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, groups, units = batch["cell"].to_numpy(), np.array(batch["grp"].to_pylist(), object), batch["unit"].to_pylist()
            row, cell = [np.arange(len(batch))], [own]
            for g in set(groups.tolist()) & set(pivots.value):
                at, p = np.flatnonzero(groups == g), pivots.value[g]
                r, error = reach(least, p.shape[1]), rounding(p.shape[1])
                near = _matrix([units[i] for i in at]) @ p.T
                # for y in the cell of p: (x - y)(own - p) >= x(own - p), and at most |x - y| |own - p|
                between = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)) + error)[own[at]]  # at least the distance of the pivots
                go = near[np.arange(len(at)), own[at]][:, None] - near <= r * between + error
                go &= (radii.value[g] >= 0) & (2 - 2 * near - error <= (radii.value[g] + r) ** 2)
                go[np.arange(len(at)), own[at]] = False
                i, c = np.nonzero(go)
                row.append(at[i])
                cell.append(c.astype(np.int32))
            row, cell = np.concatenate(row), np.concatenate(cell).astype(np.int32)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([taken["grp"], taken["unit"], taken["rep"], taken["n"], pa.array(cell), pa.array(cell == own[row])], ["grp", "unit", "rep", "n", "cell", "own"])

    return owned.mapInArrow(run, "grp string, unit binary, rep long, n long, cell int, own boolean")


def _block_join(own, other, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (kind, a, b): 0: own class a has b links here; 1: an edge of a spanning forest of the links."""
    (a_ids, a), (b_ids, b, b_n) = own, other
    links, left, right = np.zeros(len(a_ids), np.int64), [], []
    weight = b_n.astype(float)
    for lo in range(0, len(a_ids), 256):
        close = (a[lo : lo + 256] @ b.T >= least).astype(float)
        links[lo : lo + 256] = close @ weight
        # as few links as keep together what is: each column with its first row, and each row with the first rows of its columns
        some = np.flatnonzero(close.any(0))
        first = close[:, some].argmax(0)
        left.append(a_ids[lo + first])
        right.append(b_ids[some])
        of = np.zeros((len(some), len(close)))
        of[np.arange(len(some)), first] = 1
        i, j = np.nonzero(close[:, some] @ of)
        left.append(a_ids[lo + i])
        right.append(a_ids[lo + j])
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(links), np.int32)), pa.array(a_ids), pa.array(links)], ["kind", "a", "b"])
    left, right = np.concatenate(left), np.concatenate(right)
    apart = left != right
    left, right = left[apart], right[apart]
    if len(left):
        nodes, code = np.unique(np.concatenate([left, right]), return_inverse=True)
        u, v = code[: len(left)], code[len(left) :]
        root = np.arange(len(nodes))
        while True:
            low = root.copy()
            np.minimum.at(low, u, root[v])
            np.minimum.at(low, v, root[u])
            low = low[low]
            if (low == root).all():
                break
            root = low
        child = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(child), np.int32)), pa.array(nodes[child]), pa.array(nodes[root[child]])], ["kind", "a", "b"])


def _joined(visits: DataFrame, least: float) -> DataFrame:
    sizes = visits.groupBy("grp", "cell").agg(F.ceil(F.count_if("own") / BLOCK).cast("int").alias("n_own"), F.ceil(F.count("*") / BLOCK).cast("int").alias("n_all"))
    rows = visits.join(sizes, ["grp", "cell"])
    pick = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a row is side 0 (own) in the blocks of its line, side 1 (all) in those of its column, and sent once, as side 2, where they cross
    mine = rows.where("own").withColumn("i", pick("n_own")).withColumn("j", to("n_all")).withColumn("side", F.lit(0)).where(F.col("j") != pick("n_all"))
    rest = rows.where("n_own > 0").withColumn("j", pick("n_all")).withColumn("i", to("n_own"))
    rest = rest.withColumn("side", F.when(F.col("own") & (F.col("i") == pick("n_own")), 2).otherwise(1))
    keys = ["grp", "cell", "i", "j"]
    both = mine.select(*keys, "side", "rep", "n", "unit").union(rest.select(*keys, "side", "rep", "n", "unit"))

    def close(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        sides = [[r for r in group if r[4] in (s, 2)] for s in (0, 1)]
        if all(sides):
            (a, b) = ((np.array([r[5] for r in s], np.int64), _matrix([r[7] for r in s])) for s in sides)
            yield from _block_join(a, (*b, np.array([r[6] for r in sides[1]], np.int64)), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and group[0][:4] != row[:4]:
                    yield from close(group)
                    group = []
                group.append(row)
        if group:
            yield from close(group)

    return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "kind int, a long, b long")


def embedding_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    units = scratch.write(unit_vectors(rows, id_col, vector_col, label_col).withColumn("grp", F.concat_ws("/", F.length("unit"), "label")))
    part = units.where("unit IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    classes = scratch.write(part.groupBy("grp", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    pivots = spark.sparkContext.broadcast(_pivots(classes, least))
    owned = scratch.write(_own_cells(classes, pivots))
    radii: dict[str, np.ndarray] = {g: np.full(len(p), -np.inf) for g, p in pivots.value.items()}
    if radii:
        for x in owned.where(F.col("grp").isin(list(radii))).groupBy("grp", "cell").agg(F.max("far").alias("far")).collect():  # a row per pivot
            radii[x.grp][x.cell] = x.far
    visits = scratch.write(_visited(owned, pivots, spark.sparkContext.broadcast(radii), least))
    found = scratch.write(_joined(visits, least))
    scratch.drop(owned, visits)
    links = found.where("kind = 0").groupBy(F.col("a").alias("of")).agg((F.sum("b") - 1).alias("n_links"))
    joined = connected_components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    known = classes.select("grp", "unit", "rep").join(links, F.col("rep") == F.col("of"), "left").join(joined, F.col("rep") == F.col("id"), "left")
    known = scratch.write(known.select("grp", "unit", "n_links", F.coalesce("component", "rep").alias("class_id")))
    out = part.select("vec_id", "grp", "unit").join(known, ["grp", "unit"], "left").select("vec_id", "n_links", "class_id")
    alone = units.where("NOT (unit IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("class_id"))
    out = out.unionByName(alone)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("class_id").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("class_id")).alias("kept"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS reach FROM v UNION SELECT r.id, l.v FROM r JOIN l ON l.u = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""
