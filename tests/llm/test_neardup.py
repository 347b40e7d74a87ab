import random
import re

import numpy as np
import pytest

from cutweave.llm import neardup
from cutweave.llm.common import Scratch
from cutweave.llm.neardup import near_duplicates, sketch_limit
from cutweave.operators.components import connected_components

SCHEMA = "doc_id long, text string, kept string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    linked = []
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or both and 100 * both >= percent * len(sets[i] | sets[j]):
                linked.append((i, j))
    roots = components(len(rows), linked)
    smallest = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            smallest[r] = min(smallest.get(r, d), d)
    return sorted(((d, len(s), None if d is None else smallest[r], d is None or smallest[r] == d) for (d, _), s, r in zip(rows, sets, roots, strict=True)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["É", "ß,", "Ünï"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(25):
        base = make(rng.choice([5, 6, 12, 60, 200, 400]))
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append("  ".join(words) if rng.random() < 0.5 else "\n".join(words).upper())
            base = words if rng.random() < 0.5 else base  # chains
    shared = make(60)
    texts += [" ".join(make(40) + shared + make(40)) for _ in range(20)]
    texts += ["", None, " \t\n", "one", "One", "one two three four", "one two three four", "ONE two three four five", "é", "É", "same " * 50, "same " * 500, "x" * 100_000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * i + 1, texts[k]) for i, k in enumerate(order)] + [(None, "one two three four"), (None, None)]


@pytest.mark.parametrize(("seed", "block", "percent"), [(1, 1024, 85), (2, 3, 85), (3, 2, 85), (4, 4, 80)])
def test_against_brute_force(spark, monkeypatch, seed, block, percent):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 10 if seed == 2 else 10**6)
    monkeypatch.setattr(neardup, "GATHER", 300 if seed == 2 else 1 << 19)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 700 if seed == 4 else 1 << 20)
    rows = corpus(seed)
    rows += [rows[5], rows[5]]  # repeated rows
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in near_duplicates(df, percent=percent).collect()), key=str) == brute(rows, percent)


def test_star_of_copies_that_only_the_original_links(spark, monkeypatch):
    """Copies far from one another but near the original, which is not the smallest id."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = [f"v{i}" for i in range(300)]
    rows = []
    for k in range(40):
        words = list(base)
        for i in range(4):
            words[(7 * k + i * 73) % 300] = f"new{k}.{i}"
        rows.append((k, " ".join(words)))
    rows.append((1000, " ".join(base)))
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in near_duplicates(df, percent=85).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(1)
    over = 0
    limit = sketch_limit(0.85)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        a, b = np.unique(pool[:1850]), np.unique(pool[150:])  # similarity 0.85
        sets, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        s = neardup._samples(sets, at).astype(np.uint64)
        bit = (neardup.mix64(s + neardup._SALT[:, None]) % np.uint64(neardup.BITS)).astype(int)
        odd = [np.bincount(bit[:, k], minlength=neardup.BITS) & 1 for k in (0, 1)]
        over += int((odd[0] ^ odd[1]).sum() > limit)
        assert 0.6 < (s[:, 0] == s[:, 1]).mean() < 1
    assert over == 0 and sketch_limit(0.5) > limit


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(700, x) for x in range(701, 760)] + [(5, 5)]
    want = components(800, edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark)).collect()}
    touched = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: want[x] for x in touched}


def test_recall_at_the_bound(spark):
    """Pairs with a similarity of exactly 0.8 (40 of 50 shingles shared) are the least likely to share a band; all must be found."""
    rng = random.Random(12)
    rows = []
    for k in range(3000):
        words = [f"v{rng.randint(0, 10**9)}" for _ in range(49)]
        other = list(words)
        other[24] = "changed"
        assert k or len(shingles(" ".join(words)) & shingles(" ".join(other))) * 50 == 40 * len(shingles(" ".join(words)) | shingles(" ".join(other)))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, percent=80).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
