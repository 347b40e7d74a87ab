"""Counts on two street graphs of towns, which are not part of the repository: CUTWEAVE_GRAPHS names a folder of edge files."""

import os
from collections import Counter
from pathlib import Path

import pytest

from cutweave.operators.bonds import bonds
from cutweave.sources.readers import read_edges

# Fixed values: (edges of the graph) -> (m, k) -> bonds by size, worked out from the definition.
COUNTS = {
    974: {(3, 2): {1: 157, 2: 249, 3: 808}, (3, 3): {2: 12_246, 3: 39_597}, (4, 2): {1: 157, 2: 249, 3: 808, 4: 2053}},
    2066: {(3, 2): {1: 202, 2: 232, 3: 1553}},
}
FOLDER = os.environ.get("CUTWEAVE_GRAPHS")


@pytest.mark.skipif(not FOLDER, reason="CUTWEAVE_GRAPHS is not set")
def test_counts_of_towns(spark):
    met = set()
    for path in sorted(Path(FOLDER or ".").glob("*.csv")):
        edges = read_edges(spark, str(path))
        n = edges.count()
        for (m, k), want in COUNTS.get(n, {}).items():
            assert Counter(len(r.edges) for r in bonds(edges, m, k).collect()) == want, (n, m, k)
            met.add(n)
    assert met == set(COUNTS)
