"""Exact top-k search by inner product: dual-tree search over cover trees.

Components x become floor(scale * x). Pivots (a bounded sample) are the top of one tree over queries and data: every row lies in the cell of its
nearest pivot, which has a covering radius, and large cells are cut into blocks. For a query group
around q with radius a and a data cell around p with radius b no inner product exceeds <q, p> + a|p| + b|q| + ab. First each group
searches a block of the most promising cell; then the blocks of all cells whose bound reaches the group's worst k-th score so far are
searched. Bounds are worked out per group and cell (MAX_PIVOTS at most); only cells that are reached are ever paired with a group.

Inside a task both sides get a cover tree: a node's centre is also the centre of one of its children, the other centres are picked
farthest first, so centres are at least as far apart as the radius that covers the rest, and every node keeps its true covering
radius. The two trees are walked together; a pair of nodes is dropped if its bound lies below the worst k-th score of the queries below
the query node (an equal bound is followed, as ties go to smaller ids). Leaves are compared by a matrix product, exact in 64 bits.

Results do not depend on pivots, blocks or trees. Of equal vectors in a block only those with the k + 1 smallest ids can be in a result.
A vector that is null, empty or holds null or non-finite components takes no part, nor does a row without id. Vectors of different
lengths are not compared. A query's own row is any with its id. Repeated query rows are answered once; repeated candidates count each.
Scores are exact while they fit in 64 bits. A query with fewer than k candidates gets all of them; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .metricjoin import vector_rows

BLOCK, QUERIES, MAX_PIVOTS = 8192, 1024, 1024
FAN, LEAF = 32, 64


class CoverTree:
    """Nodes as arrays: centre (a vector), radius, the range of points below in `order`, children."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.center, self.radius, self.start, self.end, self.children = [], [], [], [], []
        self.points = points
        if len(points):
            self._grow(0, len(points), points[0])
        self.points = points[self.order]

    def _grow(self, start: int, end: int, center: np.ndarray) -> int:
        node = len(self.center)
        members = self.order[start:end]
        far = np.sqrt(((self.points[members] - center) ** 2).sum(1))
        self.center.append(center)
        self.radius.append(float(far.max()))
        self.start.append(start)
        self.end.append(end)
        self.children.append([])
        if end - start > LEAF and far.max() > 0:
            nearest, owner, centers = far, np.zeros(len(members), np.int64), [center]
            goal = far.max() / 2
            while len(centers) < FAN and nearest.max() > goal:
                centers.append(self.points[members[nearest.argmax()]])
                new = np.sqrt(((self.points[members] - centers[-1]) ** 2).sum(1))
                closer = new < nearest
                nearest, owner = np.where(closer, new, nearest), np.where(closer, len(centers) - 1, owner)
            by_owner = np.argsort(owner, kind="stable")
            self.order[start:end] = members[by_owner]
            edges = start + np.searchsorted(owner[by_owner], np.arange(len(centers) + 1))
            for c, a, b in zip(centers, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b > a:
                    self.children[node].append(self._grow(a, b, c))
        return node


class Best:
    """The k best (score, id) of each query: larger scores, then smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.found = k, [[] for _ in range(n)]
        self.kth = floor.astype(float)  # what a candidate has to reach

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.kth[row])
        if len(at):
            new = list(zip((-scores[at]).tolist(), ids[at].tolist(), strict=True))
            self.found[row] = heapq.nsmallest(self.k, self.found[row] + new)
            if len(self.found[row]) == self.k:
                self.kth[row] = max(self.kth[row], -self.found[row][-1][0])


def dual_search(q_ids: np.ndarray, queries: np.ndarray, d_ids: np.ndarray, data: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per query the k best (-score, id) of `data` among those that reach `floor`; int64 matrices."""
    exact = max(float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1], 1.0) < 2**53
    kind = float if exact else np.int64
    qt, dt = CoverTree(queries.astype(float)), CoverTree(data.astype(float))
    q, d, qi, di = queries[qt.order].astype(kind), data[dt.order].astype(kind), q_ids[qt.order], d_ids[dt.order]
    best = Best(len(q), k, floor[qt.order])
    qc, dc, qr, dr = np.array(qt.center), np.array(dt.center), np.array(qt.radius), np.array(dt.radius)
    qn, dn = np.sqrt((qc**2).sum(1)), np.sqrt((dc**2).sum(1))

    def bounds(a: list[int], b: list[int]) -> np.ndarray:
        top = (qc[a] * dc[b]).sum(1) + qr[a] * dn[b] + dr[b] * qn[a] + qr[a] * dr[b]
        return top + 1e-9 * np.abs(top) + 1e-6

    stack = [(math.inf, 0, 0)]
    while stack:
        bound, a, b = stack.pop()
        lo, hi = qt.start[a], qt.end[a]
        if bound < best.kth[lo:hi].min():
            continue
        if not qt.children[a] and not dt.children[b]:
            s, e = dt.start[b], dt.end[b]
            scores = q[lo:hi] @ d[s:e].T
            for i in np.flatnonzero(scores.max(1) >= best.kth[lo:hi]).tolist():
                other = di[s:e] != qi[lo + i]
                best.offer(lo + i, scores[i][other], di[s:e][other])
            continue
        split_query = qt.children[a] and (not dt.children[b] or qr[a] > dr[b])
        pairs = [(c, b) for c in qt.children[a]] if split_query else [(a, c) for c in dt.children[b]]
        tops = bounds([x for x, _ in pairs], [y for _, y in pairs])
        for i in np.argsort(tops, kind="stable").tolist():  # the best bound is popped first
            stack.append((float(tops[i]), *pairs[i]))
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]
    for at, found in zip(qt.order.tolist(), best.found, strict=True):
        out[at] = [(int(s), int(i)) for s, i in found]
    return out


def _thin(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be in a result: of equal vectors the k + 1 smallest ids, of equal rows k."""
    _, code = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, code))
    keep, last, ranks, copies = [], None, 0, 0
    for row, c, i in zip(order.tolist(), code[order].tolist(), ids[order].tolist(), strict=True):
        if last is None or last[0] != c:
            ranks, copies = 1, 1
        elif last[1] != i:
            ranks, copies = ranks + 1, 1
        else:
            copies += 1
        last = (c, i)
        if ranks <= k + 1 and copies <= k:
            keep.append(row)
    return np.array(sorted(keep), np.int64)


def _integers(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, fine = vector_rows(batch["v"])
            fine &= ~batch["vec_id"].is_null().to_numpy(zero_copy_only=False)
            out = [np.floor(scale * v).astype(np.int64) for v, ok in zip(found, fine, strict=True) if ok]
            ids = batch["vec_id"].filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(v) for v in out], pa.int32()), pa.array([v.tobytes() for v in out], pa.binary())], ["vec_id", "dim", "v"])

    plain = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return plain.mapInArrow(run, "vec_id long, dim int, v binary")


def _stack(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int64).reshape(len(values), -1)


def _pivots(data: DataFrame) -> dict[int, np.ndarray]:
    """Per length, pivots for blocks of half of BLOCK rows; MAX_PIVOTS in all but for one per length."""
    sizes = data.groupBy("dim").agg(F.count("*").alias("size"), F.min_by("v", F.xxhash64("v", "vec_id")).alias("first"))
    rows = {r.dim: r for r in sizes.collect()}  # a row per length of vectors
    total = sum(r["size"] for r in rows.values())
    wanted = {dim: max(1, min(math.ceil(2 * r["size"] / BLOCK), MAX_PIVOTS * r["size"] // total)) for dim, r in rows.items()}
    drawn: dict[int, list[bytes]] = {dim: [bytes(r.first)] for dim, r in rows.items()}
    if any(w > 1 for w in wanted.values()):
        chance = min(1.0, 3 * sum(wanted.values()) / total)
        sample = data.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < chance * (1 << 30)).select("dim", "v").distinct().limit(4 * MAX_PIVOTS + 64)
        for r in sorted(sample.collect(), key=lambda r: bytes(r.v)[::-1]):
            if len(drawn[r.dim]) < wanted[r.dim] and bytes(r.v) not in drawn[r.dim]:
                drawn[r.dim].append(bytes(r.v))
    return {dim: _stack(v) for dim, v in drawn.items()}


def _placed(rows: DataFrame, pivots, per: int) -> DataFrame:
    """Rows with cell (nearest pivot; queries use as many pivots as they need groups), distance, and block in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            dims, v, limit = batch["dim"].to_numpy(), batch["v"].to_pylist(), batch["cells"].to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x, p = _stack([v[i] for i in at]).astype(float), pivots.value[dim][: limit[at[0]]].astype(float)
                d2 = np.maximum(0, (x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * (x @ p.T))
                cell[at] = d2.argmin(1)
                far[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.select(["vec_id", "dim", "v"]).columns, pa.array(cell), pa.array(far)], ["vec_id", "dim", "v", "cell", "far"])

    counts = rows.groupBy("dim").agg(F.ceil(F.count("*") / per).cast("int").alias("cells"))
    counts = F.broadcast(counts)  # a row per length of vectors
    out = rows.join(counts, "dim").select("vec_id", "dim", "v", "cells").mapInArrow(run, "vec_id long, dim int, v binary, cell int, far double")
    cells = out.groupBy("dim", "cell").agg(F.ceil(F.count("*") / per).cast("int").alias("blocks"))
    return out.join(cells, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).drop("blocks")


def _reached(groups: DataFrame, pivots, radii) -> DataFrame:
    """Query groups with the data cells that they search: those whose bound reaches the group's `worst`; where it is null, the most promising one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            dims, own, far, worst = (batch[c].to_numpy(zero_copy_only=False) for c in ("dim", "q_cell", "q_far", "worst"))
            for dim in np.unique(dims).tolist():
                at, p = np.flatnonzero(dims == dim), pivots.value[dim].astype(float)
                some = np.flatnonzero(radii.value[dim] >= 0)
                norm, r, s = np.sqrt((p**2).sum(1)), far[at][:, None], radii.value[dim][some]
                bound = p[own[at]] @ p[some].T + r * norm[some] + norm[own[at]][:, None] * s + r * s
                bound += 1e-9 * np.abs(bound) + 1e-3
                go = np.where(np.isnan(worst[at])[:, None], np.arange(len(some)) == bound.argmax(1)[:, None], bound >= worst[at][:, None])
                i, j = np.nonzero(go)
                row.append(at[i])
                cell.append(some[j])
            taken = batch.select(keys).take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(cell).astype(np.int32))], [*keys, "cell"])

    keys = ["dim", "q_cell", "q_block"]
    return groups.select(*keys, "q_far", F.col("worst").cast("double")).mapInArrow(run, "dim int, q_cell int, q_block int, cell int")


def _searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(query_id, query, score, vec_id) candidates from the pairs of blocks; queries carry `floor`, the k-th score known so far.

    `query` tells apart queries of one id with different vectors.
    """
    keys = ["dim", "q_cell", "q_block", "cell", "block"]
    left = queries.join(pairs, ["dim", "q_cell", "q_block"]).select(*keys, F.lit(0).alias("side"), "vec_id", "v", "floor", "query")
    right = data.join(pairs, ["dim", "cell", "block"]).select(*keys, F.lit(1).alias("side"), "vec_id", "v", F.lit(0.0).alias("floor"), F.lit(0).cast("long").alias("query"))

    def close(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b = ([r for r in group if r[5] == side] for side in (0, 1))
        if a and b:
            ids, data_ = np.array([r[6] for r in b], np.int64), _stack([r[7] for r in b])
            keep = _thin(ids, data_, k)
            q_ids = np.array([r[6] for r in a], np.int64)
            found = dual_search(q_ids, _stack([r[7] for r in a]), ids[keep], data_[keep], k, np.array([r[8] for r in a]))
            flat = [(r[6], r[9], -s, i) for r, f in zip(a, found, strict=True) for s, i in f]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], pa.int64()) for c in range(4)], ["query_id", "query", "score", "vec_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and group[0][:5] != row[:5]:
                    yield from close(group)
                    group = []
                group.append(row)
        if group:
            yield from close(group)

    rows = left.union(right).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "query_id long, query long, score long, vec_id long")


def exact_top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of all for each query row."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    data = scratch.write(_integers(rows, id_col, vector_col, scale))
    asked = data.where(is_query).dropDuplicates(["vec_id", "v"])
    pivots = spark.sparkContext.broadcast(_pivots(data))
    placed = scratch.write(_placed(data, pivots, BLOCK))
    queries = _placed(asked, pivots, QUERIES).withColumnsRenamed({"cell": "q_cell", "block": "q_block", "far": "q_far"})
    queries = scratch.write(queries.withColumn("query", F.xxhash64("vec_id", "v")))
    keys = ["dim", "q_cell", "q_block"]
    groups = queries.groupBy(*keys).agg(F.max("q_far").alias("q_far"))
    blocks = scratch.write(placed.groupBy("dim", "cell", "block").agg(F.max("far").alias("far")))
    radii = {dim: np.full(len(p), -1.0) for dim, p in pivots.value.items()}
    for x in blocks.groupBy("dim", "cell").agg(F.max("far").alias("far")).collect():  # a row per pivot
        radii[x.dim][x.cell] = x.far
    radii = spark.sparkContext.broadcast(radii)
    best_cell = _reached(groups.withColumn("worst", F.lit(None)), pivots, radii)
    first = scratch.write(best_cell.join(blocks.groupBy("dim", "cell").agg(F.min("block").alias("block")), ["dim", "cell"]))
    lowest = float(-(2**62))
    seeds = scratch.write(_searched(first, queries.withColumn("floor", F.lit(lowest)), placed, k))
    kth = seeds.groupBy("query_id", F.col("query").alias("which")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
    queries = queries.join(kth, (F.col("vec_id") == F.col("query_id")) & (F.col("query") == F.col("which")), "left")
    queries = queries.withColumn("floor", F.coalesce("kth", F.lit(lowest))).drop("query_id", "which", "kth")
    queries = scratch.write(queries)
    groups = queries.groupBy(*keys).agg(F.max("q_far").alias("q_far"), F.min("floor").alias("worst"))
    rest = _reached(groups, pivots, radii).join(blocks.drop("far"), ["dim", "cell"]).join(first, [*keys, "cell", "block"], "left_anti")
    found = seeds.union(_searched(rest, queries, placed, k))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
