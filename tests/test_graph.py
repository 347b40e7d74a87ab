import random

import pytest
from pyspark.sql import functions as F

from cutweave.operators import graph as G
from cutweave.operators import small
from cutweave.operators.cuts import check_cuts
from cutweave.plans.derived import TWO_SQUARES, graph5
from cutweave.sources.generators import density_cells, grid, random_graph


def frame(spark, edges):
    return spark.createDataFrame(edges, "id int, src int, dst int")


def plain_components(edges, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for _, u, v in edges:
            low = min(label[u], label[v])
            changed |= label[u] != low or label[v] != low
            label[u] = label[v] = low
    return label


@pytest.fixture(params=[500_000, 0], ids=["one task", "joins"])
def either_path(request, monkeypatch):
    monkeypatch.setattr(small, "LOCAL_EDGES", request.param)


def edges_of(seed, n=12, m=16):
    rng = random.Random(seed)
    return [(i * 3 + 1, rng.randrange(n), rng.randrange(n)) for i in range(m)]


def test_components_with_isolated_nodes_and_loops(spark, either_path):
    edges = edges_of(1) + [(100, 50, 50)]
    extra = spark.createDataFrame([(70,), (0,)], "node int")
    nodes = {n for _, u, v in edges for n in (u, v)} | {70, 0}
    assert {r.node: r.component for r in G.components(frame(spark, edges), extra).collect()} == plain_components(edges, nodes)
    assert G.component_count(frame(spark, edges), extra).first()[0] == len(set(plain_components(edges, nodes).values()))


def test_spanning_forest(spark, either_path):
    edges = edges_of(2) + [(200, 3, 3), (0, 3, 4), (201, 3, 4)]
    want, seen = set(), []
    for e, u, v in sorted(edges):
        nodes = {n for _, a, b in seen for n in (a, b)} | {u, v}
        part = plain_components(seen, nodes)
        if part[u] != part[v]:
            want.add(e)
            seen.append((e, u, v))
    assert {r.id for r in G.spanning_forest(frame(spark, edges)).collect()} == want
    assert [r.id for r in G.spanning_forest(frame(spark, edges), limit=2).collect()] == sorted(want)[:2]


def test_hops_and_paths(spark, either_path):
    got = {r.node: r.hops for r in G.bfs_hops(graph5(spark), [0]).collect()}
    assert got == {0: 0, 1: 1, 3: 1, 2: 2, 4: 2, 5: 3, 7: 3, 6: 4}
    blocked = F.col("id").isin(3, 9)
    assert G.shortest_path_length(graph5(spark), [0], [4], blocked).first()[0] == 4
    assert G.shortest_path_length(graph5(spark), [0], [99]).first()[0] is None


def test_canonical_path(spark, either_path):
    path = lambda *a: [r.id for r in G.canonical_path(graph5(spark), *a).orderBy("pos").collect()]
    assert path([0], [4]) == [3, 9] and path([0, 1], [5]) == [1, 8] and path([0], [0]) == [] and path([0], [99]) == []
    assert path([0], [6]) == [0, 1, 8, 5] and path([0], [6], F.col("id") == 8) == [3, 9, 4, 5]


def test_make_connected(spark):
    edges = [(1, 0, 1), (2, 4, 5), (3, 8, 9)]
    links = G.make_connected(frame(spark, edges), spark.createDataFrame([(20,)], "node int"))
    assert [tuple(r) for r in links.orderBy("id").collect()] == [(4, 0, 4), (5, 4, 8), (6, 8, 20)]
    assert G.make_connected(graph5(spark)).count() == 0


def test_labels_tell_cuts(spark, either_path):
    edges = edges_of(3, 6, 9) + [(90, 2, 2)]
    label = {r.id: r.label for r in G.cycle_labels(frame(spark, edges), seed=4).collect()}
    nodes = {n for _, u, v in edges for n in (u, v)}
    assert min(label.values()) >= 0
    for mask in range(1 << len(nodes)):
        side = {n for i, n in enumerate(sorted(nodes)) if mask >> i & 1}
        total = 0
        for e, u, v in edges:
            if (u in side) != (v in side):
                total ^= label[e]
        assert total == 0
    rng = random.Random(5)
    for _ in range(100):
        chosen = set(rng.sample(sorted(label), rng.randint(1, 4)))
        total = 0
        for e in chosen:
            total ^= label[e]
        cut = any(
            chosen == {e for e, u, v in edges if (u in side) != (v in side)}
            for mask in range(1 << len(nodes))
            for side in [{n for i, n in enumerate(sorted(nodes)) if mask >> i & 1}]
        )
        assert (total == 0) == cut


def test_labels_do_not_depend_on_the_path(spark, monkeypatch):
    edges = edges_of(8, 20, 30) + [(90, 2, 2), (91, 40, 41)]
    one = {r.id: r.label for r in G.cycle_labels(frame(spark, edges), seed=1).collect()}
    monkeypatch.setattr(small, "LOCAL_EDGES", 0)
    assert {r.id: r.label for r in G.cycle_labels(frame(spark, edges), seed=1).collect()} == one


def test_blocks_hold_the_minimal_cuts():
    """Two edges are in one block iff a cycle without repeated nodes has both: iff no node separates them."""
    rng = random.Random(11)
    for _ in range(80):
        edges = [(i, rng.randrange(7), rng.randrange(7)) for i in range(rng.randint(1, 11))]
        block = dict(zip(*(lambda f: (f.ids, f.blocks()))(small.Forest(*zip(*edges, strict=True))), strict=True))
        plain = [(e, u, v) for e, u, v in edges if u != v]
        same = {(a, b) for a, *_ in plain for b, *_ in plain if block[a] == block[b]}
        want = {(e, e) for e, *_ in plain}
        for mask in range(1 << len(plain)):  # cycles: connected sets in which every node has degree two
            chosen = [x for i, x in enumerate(plain) if mask >> i & 1]
            nodes = [n for _, u, v in chosen for n in (u, v)]
            if chosen and all(nodes.count(n) == 2 for n in nodes) and len(set(plain_components(chosen, set(nodes)).values())) == 1:
                want |= {(a, b) for a, *_ in chosen for b, *_ in chosen}
        assert same == transitive(want)


def transitive(pairs):
    while True:
        more = {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs
        if not more:
            return pairs
        pairs = pairs | more


def test_checks_against_traversal(spark):
    rng = random.Random(6)
    edges = edges_of(7, 8, 11)
    nodes = {n for _, u, v in edges for n in (u, v)}
    cuts = [sorted(rng.sample([e for e, _, _ in edges], rng.randint(0, 5))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(cuts)), "line_no long, edges array<int>")
    for r in check_cuts(frame(spark, edges), df).collect():
        part = plain_components([e for e in edges if e[0] not in r.edges], nodes)
        k = len(set(part.values()))
        fine = all(part[u] != part[v] for e, u, v in edges if e in r.edges)
        assert (r.n_components, r.status) == (k, "false_not_cut" if k == 1 else "true" if fine else "false_not_minimal")


def test_without_is_an_anti_join(spark):
    removed = spark.createDataFrame([(0,), (1,), (77,)], "id int")
    assert sorted(r.id for r in G.without(graph5(spark), removed).collect()) == list(range(2, 10))


def test_random_graphs(spark):
    a, b = (sorted(map(tuple, random_graph(spark, 15, 14, 30, seed=9).collect())) for _ in range(2))
    assert a == b and len({(u, v) for _, u, v in a}) == len(a) and all(u != v for _, u, v in a)
    assert G.component_count(frame(spark, a), spark.range(15).select(F.col("id").cast("int").alias("node"))).first()[0] == 1
    with pytest.raises(ValueError):
        random_graph(spark, 3, 1, 9)


def test_grids(spark):
    assert sorted(map(tuple, grid(spark, (1, 3), (2, 4)).collect())) == [(2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 3)]
    assert sorted(map(tuple, grid(spark, (3, 3), (3, 4), lead=0).collect())) == [(3, 3)]
    assert density_cells(spark, 4, 5, 2).count() == 4
    assert TWO_SQUARES[0] == (0, 0, 1)
