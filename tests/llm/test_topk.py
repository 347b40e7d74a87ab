import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave.llm import topk
from cutweave.llm.topk import CoverTree, dual_search, exact_top_k

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int"


def brute(rows, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in fine:
        if i % 50 == 0 and (i, tuple(q)) not in seen:
            seen.add((i, tuple(q)))
            best = sorted((-sum(a * b for a, b in zip(q, d, strict=True)), j) for j, d in fine if j != i and len(d) == len(q))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "group", "dim"), [(8192, 1024, 6), (40, 4, 3), (64, 8, 32)])
def test_against_brute_force(spark, monkeypatch, block, group, dim):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", group)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(dim)
    centers = rng.normal(size=(6, dim))
    rows = [(int(i), [float(x) for x in centers[i % 6] + rng.normal(size=dim) * 0.2]) for i in rng.permutation(700)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)] + [(50, rows[0][1])] * 3 + [(3000, rows[7][1])] * 9
    rows += [(4000, None), (4050, []), (4100, [math.nan] * dim), (4150, [None] * dim), (4200, [0.0] * dim), (5000, [1.0] * 2), (5050, [1.0, 2.0]), (5100, [7.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1, "clash", 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows)


def test_dual_search_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(c, 3, size=(500, 4)) for c in (-200, 0, 150, 300)]).astype(np.int64)
    ids = rng.permutation(len(data)).astype(np.int64)
    queries = data[:80]
    got = dual_search(ids[:80], queries, ids, data, 5, np.full(80, -np.inf))
    full = queries @ data.T
    for i in range(80):
        order = sorted((-int(s), int(j)) for s, j in zip(full[i], ids, strict=True) if j != ids[i])[:5]
        assert got[i] == order


def test_cover_tree_invariants():
    points = np.random.default_rng(2).normal(size=(900, 3))
    tree = CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(900))
    for n in range(len(tree.center)):
        below = tree.points[tree.start[n] : tree.end[n]]
        assert np.sqrt(((below - tree.center[n]) ** 2).sum(1)).max() <= tree.radius[n] + 1e-9
        kids = tree.children[n]
        if kids:
            assert any((tree.center[c] == tree.center[n]).all() for c in kids)
            apart = min(np.linalg.norm(tree.center[a] - tree.center[b]) for a in kids for b in kids if a != b)
            assert apart + 1e-9 >= max(tree.radius[c] for c in kids)


def test_large_values_stay_exact():
    data = np.array([[2**29, 1], [2**29, 2], [-(2**29), 3]], np.int64)
    got = dual_search(np.array([9]), np.array([[2**30, 1]], np.int64), np.array([1, 2, 3]), data, 2, np.array([-np.inf]))
    assert got == [[(-(2**59 + 2), 2), (-(2**59 + 1), 1)]]


def test_empty(spark):
    assert exact_top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
