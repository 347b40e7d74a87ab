import math

import numpy as np
import pytest

from cutweave.llm import metricjoin
from cutweave.llm.metricjoin import embedding_duplicates

from .test_neardup import components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, unit int"


def brute(rows, least=0.93):
    ok = lambda v, y: v is not None and y is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if i is not None and ok(v, y) else None for i, v, y in rows]
    pairs, links = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                pairs.append((a, b))
                links[a] += 1
                links[b] += 1
    roots = components(len(rows), pairs)
    low = {}
    for (i, *_), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, n, low.get(r), i == low.get(r)) for (i, *_), n, r in zip(rows, links, roots, strict=True)), key=str)


def vectors(seed, dim):
    rng = np.random.default_rng(seed)
    rows, centers = [], rng.normal(size=(30, dim))
    for k in range(400):
        v = centers[k % 30] + rng.normal(size=dim) * (0.25 if k % 3 else 1.0)
        rows.append((2 * k + 1, [float(np.float32(x)) for x in v], int(k % 7 > 1)))
    rows += [(5000 + k, rows[3][1], rows[3][2]) for k in range(50)] + [(6000, [2 * x for x in rows[3][1]], rows[3][2])]
    rows += [(7000, None, 1), (7001, [], 1), (7002, [0.0] * dim, 1), (7003, [math.nan] + [1.0] * (dim - 1), 1), (7004, [None] + [1.0] * (dim - 1), 1)]
    rows += [(7005, rows[3][1], None), (7006, [1.0, 0.0, 0.0], 1), (7007, [1.0, 0.001, 0.0], 1), (7008, [-0.0, 1.0, 0.0], 1), (7009, [0.0, 1.0, 0.0], 1), (7010, [math.inf] * dim, 1)]
    return rows + [(None, rows[3][1], rows[3][2]), (1, rows[0][1], rows[0][2])]


@pytest.mark.parametrize(("seed", "dim", "cell", "block"), [(1, 5, 20, 7), (2, 24, 30, 2048), (3, 4, 2048, 16), (4, 3, 10, 40)])
def test_against_brute_force(spark, monkeypatch, seed, dim, cell, block):
    monkeypatch.setattr(metricjoin, "CELL", cell)
    monkeypatch.setattr(metricjoin, "BLOCK", block)
    rows = vectors(seed, dim)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in embedding_duplicates(df).collect()), key=str) == brute(rows)


def test_bounds_prune_clustered_data(spark, monkeypatch):
    """On separated clusters few vectors are replicated; the count is what the triangle inequality leaves."""
    monkeypatch.setattr(metricjoin, "CELL", 50)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 16))
    rows = [(k, [float(x) for x in centers[k % 8] + rng.normal(size=16) * 0.02], 1) for k in range(800)]
    seen = []
    old = metricjoin._joined
    monkeypatch.setattr(metricjoin, "_joined", lambda v, least: (seen.append(v.count()), old(v, least))[1])
    got = embedding_duplicates(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)).collect()
    assert {r.n_links for r in got} == {99} and len({r.component_id for r in got}) == 8
    assert seen[0] < 8 * 800


def near_copies(n, dim, noise, seed):
    """Half of the rows are copies of one vector but for `noise`, half lie around it."""
    rng = np.random.default_rng(seed)
    center = rng.normal(size=dim)
    center /= np.linalg.norm(center)
    x = np.concatenate([center + noise * rng.normal(size=(n // 2, dim)), center + 0.12 * rng.normal(size=(n - n // 2, dim))])
    return x[rng.permutation(n)]


def links_of(x, least=0.93):
    u = x / np.abs(x).max(1)[:, None]
    u /= np.sqrt((u * u).sum(1))[:, None]
    return np.concatenate([(u[a : a + 1000] @ u.T >= least).sum(1) - 1 for a in range(0, len(u), 1000)])


def counted(spark, x):
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    return np.array([r.n_links for r in sorted(embedding_duplicates(df).collect(), key=lambda r: r.vec_id)])


@pytest.mark.parametrize("noise", [1e-7, 8e-9, 1e-12, 1e-15])
def test_pivots_may_be_near_copies(spark, monkeypatch, noise):
    """Pivots are taken as they come, so that many of them are copies but for the noise."""
    monkeypatch.setattr(metricjoin, "CELL", 40)
    monkeypatch.setattr(metricjoin, "spread", lambda points, wanted, least: points[:wanted])
    x = near_copies(600, 16, noise, 3)
    assert (counted(spark, x) == links_of(x)).all()


def test_near_copies_with_cells_as_built(spark):
    x = near_copies(14_000, 16, 8e-9, 4)
    assert metricjoin.CELL < 14_000
    assert (counted(spark, x) == links_of(x)).all()


def test_spread_pivots_are_apart():
    x = near_copies(400, 8, 1e-9, 5)
    x /= np.linalg.norm(x, axis=1)[:, None]
    p = metricjoin.spread(x, 50, 0.93)
    gaps = np.linalg.norm(p[:, None] - p[None], axis=2)[np.triu_indices(len(p), 1)]
    assert len(p) > 1 and gaps.min() >= metricjoin.reach(0.93, 8) / 2 - 1e-9


def test_empty(spark):
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
