"""k-bonds of one small graph by plain sets, from the definition: what differential tests compare the engine with."""

from __future__ import annotations

from itertools import combinations

Edge = tuple[int, int, int]


def component_map(edges: list[Edge], nodes: set[int], removed: frozenset[int]) -> dict[int, int]:
    root = {n: n for n in nodes}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for e, u, v in edges:
        if e not in removed:
            root[find(u)] = find(v)
    return {n: find(n) for n in nodes}


def by_definition(edges: list[Edge], m: int, low: int, high: int) -> set[tuple[int, tuple[int, ...]]]:
    nodes = {n for _, u, v in edges for n in (u, v)}
    out = set()
    for size in range(1, min(m, len(edges)) + 1):
        for chosen in combinations(sorted(edges), size):
            part = component_map(edges, nodes, frozenset(e for e, _, _ in chosen))
            k = len(set(part.values()))
            if k >= 2 and low <= k <= high and all(part[u] != part[v] for _, u, v in chosen):
                out.add((k, tuple(e for e, _, _ in chosen)))
    return out
