import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cutweave.operators import bonds as B
from cutweave.operators.reference_methods import by_definition
from cutweave.plans.derived import TWO_SQUARES, graph5
from cutweave.sources.generators import all_connected_graphs

SIZES = {
    2: {2: 7, 3: 12, 4: 9}, 3: {3: 2, 4: 33, 5: 72}, 4: {5: 18, 6: 135}, 5: {6: 3, 7: 108}, 6: {8: 45}, 7: {9: 10}, 8: {10: 1},
}


def frame(spark, edges):
    return spark.createDataFrame(edges, "id int, src int, dst int").coalesce(1)


def found(df):
    rows = [(r.k, tuple(r.edges)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_multigraph(rng, connected=True):
    n = rng.randint(2, 6)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 9))]
    if connected:
        edges += [(i, rng.randrange(i)) for i in range(1, n)]
    ids = rng.sample(range(100), len(edges))
    return [(i, u, v) for i, (u, v) in zip(ids, edges, strict=True)]


def test_golden_counts_of_the_small_graph():
    got = by_definition(TWO_SQUARES, 10, 2, 8)
    assert {k: dict(Counter(len(c) for kk, c in got if kk == k)) for k in SIZES} == SIZES


def test_two_bonds_of_the_small_graph(spark):
    got = {"".join(map(str, c)) for _, c in found(B.bonds(graph5(spark), 4, 2))}
    want = "01 03 13 56 57 67 89 028 029 128 129 238 239 458 459 468 469 478 479 0245 0246 0247 1245 1246 1247 2345 2346 2347"
    assert got == set(want.split())


def random_graphs(spark, n, seed):
    rng = random.Random(seed)
    rows = [(g, *e) for g in range(n) for e in random_multigraph(rng, connected=g % 3 > 0)]
    return spark.createDataFrame(rows, "graph_id long, id int, src int, dst int")


def test_engine_agrees_with_the_definition_on_random_multigraphs(spark):
    assert B.differential(random_graphs(spark, 300, 1), 6, "2-5").count() == 0


def test_differential_finds_an_injected_fault(spark, monkeypatch):
    graphs, whole = random_graphs(spark, 20, 3), B.two_bonds
    monkeypatch.setattr(B, "two_bonds", lambda labels, m: whole(labels, m).where("size(edges) <> 2 OR g <> 4"))
    diff = B.differential(graphs, 3, "2")
    assert {(r.graph_id, r.method) for r in diff.collect()} == {(4, "definition")}
    assert {r.graph_id for r in B.failing_graphs(graphs, diff).collect()} == {4}


def test_join_algebra_against_the_definition(spark):
    rng = random.Random(2)
    for i in range(5):
        edges = random_multigraph(rng, connected=i > 1)
        want = by_definition(edges, 4, 2, 4)
        assert found(B.bonds(frame(spark, edges), 4, "2-4")) == want, edges
        if i % 2:
            assert found(B.bonds(frame(spark, edges), 3, "2-3", "brute")) == {(k, c) for k, c in want if len(c) <= 3 and k <= 3}


def test_shuffled_unions_and_exact_check(spark, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_BONDS", 0)
    got = found(B.bonds(graph5(spark), 4, "2-4", exact=True))
    assert got == by_definition(TWO_SQUARES, 4, 2, 4)


def test_all_connected_graphs_on_four_nodes(spark):
    graphs = all_connected_graphs(spark, 4)
    assert graphs.select("graph_id").distinct().count() == 38
    assert B.differential(graphs, 6, "2-4").count() == 0


def test_failing_graphs_are_kept(spark):
    graphs = all_connected_graphs(spark, 3)
    odd = spark.createDataFrame([(7, "labels", 2, [0, 1])], "graph_id long, method string, k int, edges array<int>")
    assert {r.graph_id for r in B.failing_graphs(graphs, odd).collect()} == {7}


def test_accidents_are_caught(spark, monkeypatch):
    """With labels that collide, the exact check removes what the definition does not accept."""
    label = lambda e, seed=0: e.select("id", "src", "dst", F.lit(5).cast("long").alias("label"), F.lit(0).cast("long").alias("block"), F.lit(1).alias("base"))
    monkeypatch.setattr(B, "labelled", label)
    loose, exact = found(B.bonds(graph5(spark), 2, 2)), found(B.bonds(graph5(spark), 2, 2, exact=True))
    assert len(loose) == 45 and len(exact) == 7


@pytest.mark.parametrize(("m", "k"), [(0, "2"), (3, "1"), (3, "9"), (2, "0-1")])
def test_nothing_to_find(spark, m, k):
    assert B.bonds(graph5(spark), m, k).count() == 0


def test_arguments(spark):
    assert B.parse_k("3") == (3, 3) and B.parse_k("2-4") == (2, 4)
    for bad in ("x", "2-", "4-2", "a-b"):
        with pytest.raises(ValueError):
            B.parse_k(bad)
    with pytest.raises(ValueError):
        B.bonds(graph5(spark), 2, 2, "magic")


def test_disconnected_counts_components_absolutely(spark):
    edges = [(1, 0, 1), (2, 2, 3), (3, 2, 3)]
    assert found(B.bonds(frame(spark, edges), 2, "2-4")) == by_definition(edges, 2, 2, 4) == {(3, (1,)), (3, (2, 3))}


def test_empty_graph(spark):
    assert B.bonds(frame(spark, []), 3, "2-3").count() == 0
    assert B.bonds(frame(spark, []), 3, "2-3", "brute").count() == 0
