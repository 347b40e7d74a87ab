"""Algorithms on one small graph inside one task, for frames that hold a graph per key.

A graph is small if it has at most LOCAL_EDGES edges (some 12 MB); callers check that before they come here.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd

LOCAL_EDGES = 500_000


class Forest:
    """Minimal spanning forest by id, with parents, an order from the roots outwards, and the components."""

    def __init__(self, ids, src, dst):
        order = np.argsort(ids, kind="stable")
        self.ids, self.src, self.dst = (np.asarray(a)[order].tolist() for a in (ids, src, dst))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        self.tree, near = [], {}
        for i, (u, v) in enumerate(zip(self.src, self.dst, strict=True)):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
                self.tree.append(i)
                near.setdefault(u, []).append((v, i))
                near.setdefault(v, []).append((u, i))
        self.component = {x: find(x) for x in root}
        self.parent: dict[int, tuple[int, int]] = {}
        self.outwards = []
        seen = set()
        for start in sorted(set(self.component.values())):
            todo = deque([start])
            seen.add(start)
            while todo:
                u = todo.popleft()
                self.outwards.append(u)
                for v, i in near.get(u, ()):
                    if v not in seen:
                        seen.add(v)
                        self.parent[v] = (u, i)
                        todo.append(v)

    def labels(self, hashes) -> list[int]:
        """Cycle-space labels by edge position: XOR over a set is 0 iff (but for hash accidents) the set is a cut. hashes: by edge position."""
        label, on_tree = list(hashes), set(self.tree)
        below = dict.fromkeys(self.component, 0)
        for i, h in enumerate(label):
            if i not in on_tree and self.src[i] != self.dst[i]:
                below[self.src[i]] ^= h
                below[self.dst[i]] ^= h
        for v in reversed(self.outwards):
            if v in self.parent:
                u, i = self.parent[v]
                label[i] = below[v]
                below[u] ^= below[v]
        return label

    def blocks(self) -> list[int]:
        """By edge position an id of its biconnected block. No minimal cut has edges of two blocks."""
        depth = {}
        for v in self.outwards:
            depth[v] = depth[self.parent[v][0]] + 1 if v in self.parent else 0
        block = list(range(len(self.ids)))
        top = {i: u for u, i in self.parent.values()}  # the node of a block next to the root, by the block's id

        def find(i: int) -> int:
            while block[i] != i:
                block[i] = block[block[i]]
                i = block[i]
            return i

        on_tree = set(self.tree)
        for i, (u, v) in enumerate(zip(self.src, self.dst, strict=True)):
            if i in on_tree or u == v:
                continue
            whole = None  # the path between the ends in the forest becomes one block, in strides of the blocks it has
            while u != v:
                if depth[u] < depth[v]:
                    u, v = v, u
                own = find(self.parent[u][1])
                u = top[own]
                if whole is None:
                    whole = own
                elif whole != own:
                    block[own] = whole
                    top[whole] = min(top[whole], top[own], key=depth.__getitem__)
            block[i] = whole
        return [self.ids[find(i)] for i in range(len(block))]


class CutChecker:
    """What removing a cut leaves of one graph, by the definition: the pieces of its forest, joined by the other edges."""

    def __init__(self, ids, src, dst):
        f = Forest(ids, src, dst)
        self.place = {i: k for k, i in enumerate(f.ids)}
        self.ends = list(zip(f.src, f.dst, strict=True))
        first = {v: k for k, v in enumerate(sorted(set(f.component.values())))}
        self.n = len(first)
        near: dict[int, list[int]] = {}
        for v, (u, _) in f.parent.items():
            near.setdefault(u, []).append(v)
        self.enter, self.leave, clock = {}, {}, 0
        for root in sorted(first):
            todo = [(root, False)]
            while todo:
                v, done = todo.pop()
                if done:
                    self.leave[v] = clock
                    continue
                self.enter[v] = clock
                clock += 1
                todo.append((v, True))
                todo += [(w, False) for w in near.get(v, ())]
        self.below = {i: v for v, (_, i) in f.parent.items()}  # the node under each edge of the forest, by position
        self.start = np.array([first[f.component[v]] for v in sorted(self.enter, key=self.enter.__getitem__)], np.int64)
        self.rest = np.array(sorted(set(range(len(f.ids))) - set(f.tree)), np.int64)
        self.a = np.array([self.enter[f.src[i]] for i in self.rest], np.int64)
        self.b = np.array([self.enter[f.dst[i]] for i in self.rest], np.int64)

    def check(self, cut: list[int]) -> tuple[int, bool]:
        """Components left, and whether every edge of the cut lies between two of them; unknown ids are left out."""
        at = {self.place[e] for e in cut if e in self.place}
        spans = sorted((self.enter[self.below[i]], self.leave[self.below[i]]) for i in at if i in self.below)

        def piece(where: np.ndarray) -> np.ndarray:
            out = self.start[where]
            for k, (lo, hi) in enumerate(spans):  # outer ones first
                out[(where >= lo) & (where < hi)] = self.n + k
            return out

        root = list(range(self.n + len(spans)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = piece(self.a), piece(self.b)
        links = np.flatnonzero(a != b)
        for i, x, y in zip(self.rest[links].tolist(), a[links].tolist(), b[links].tolist(), strict=True):
            if i not in at:
                root[find(x)] = find(y)
        k = sum(find(x) == x for x in range(len(root)))
        ends = piece(np.array([self.enter[v] for i in at for v in self.ends[i]], np.int64)).tolist()
        return k, all(find(x) != find(y) for x, y in zip(ends[::2], ends[1::2], strict=True))


def label_graph(graph: pd.DataFrame) -> pd.DataFrame:
    """id, src, dst, label, block, base (components of the graph) from id, src, dst, h (a hash per edge)."""
    f = Forest(graph["id"], graph["src"], graph["dst"])
    hashes = graph["h"].to_numpy()[np.argsort(graph["id"].to_numpy(), kind="stable")].tolist()
    base = len(set(f.component.values()))
    return pd.DataFrame({"id": f.ids, "src": f.src, "dst": f.dst, "label": f.labels(hashes), "block": f.blocks(), "base": base})


def forest_ids(graph: pd.DataFrame) -> pd.DataFrame:
    f = Forest(graph["id"], graph["src"], graph["dst"])
    return pd.DataFrame({"id": [f.ids[i] for i in f.tree]}, dtype="int64")


def component_map(graph: pd.DataFrame) -> pd.DataFrame:
    f = Forest(graph["id"], graph["src"], graph["dst"])
    return pd.DataFrame({"id": list(f.component), "component": list(f.component.values())}, dtype="int64")


def hops(graph: pd.DataFrame, sources: set[int]) -> pd.DataFrame:
    near: dict[int, list[int]] = {}
    for u, v in zip(graph["src"].tolist(), graph["dst"].tolist(), strict=True):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    far = {s: 0 for s in sources if s in near}
    todo = deque(sorted(far))
    while todo:
        u = todo.popleft()
        for v in near[u]:
            if v not in far:
                far[v] = far[u] + 1
                todo.append(v)
    return pd.DataFrame({"node": list(far), "hops": list(far.values())}, dtype="int64")


def canonical_path(graph: pd.DataFrame, sources: set[int], targets: set[int]) -> pd.DataFrame:
    """Of the paths with fewest edges from a source to a target, that with the smallest sequence of edge ids."""
    far = dict(hops(graph, targets).itertuples(index=False))
    near: dict[int, list[tuple[int, int]]] = {}
    for i, u, v in zip(graph["id"].tolist(), graph["src"].tolist(), graph["dst"].tolist(), strict=True):
        near.setdefault(u, []).append((i, v))
        near.setdefault(v, []).append((i, u))
    left = min((far[s] for s in sources if s in far), default=0)
    at, path = {s for s in sources if far.get(s) == left}, []
    while left:
        left -= 1
        edge = min(i for u in at for i, v in near[u] if far.get(v) == left)
        at = {v for u in at for i, v in near[u] if i == edge and far.get(v) == left}
        path.append(edge)
    return pd.DataFrame({"pos": range(len(path)), "id": path}, dtype="int64")
