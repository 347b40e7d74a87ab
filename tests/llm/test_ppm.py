import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cutweave.llm.ppm import END, ORDER, PAD, score_documents

SCHEMA = "doc_id long, text string, score string, block int, train int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Brute:
    """The definition, one symbol at a time, with plain dictionaries."""

    def __init__(self, texts, max_entries):
        self.total, self.kept = defaultdict(Counter), [defaultdict(Counter) for _ in range(ORDER + 1)]
        counts = [defaultdict(Counter) for _ in range(ORDER + 1)]
        symbols = 0
        for t in texts:
            stream = [PAD] * ORDER + list(t.encode().lower()) + [END]
            for i in range(ORDER, len(stream)):
                symbols += 1
                for k in range(ORDER + 1):
                    counts[k][tuple(stream[i - k : i])][stream[i]] += 1
        self.sums = [{c: sum(s.values()) for c, s in level.items()} for level in counts]
        for k, level in enumerate(counts):
            for c, s in level.items():
                for x, n in s.items():
                    if n * max_entries >= symbols:
                        self.kept[k][c][x] = n

    def symbol(self, context, x):
        out, excluded = 0.0, set()
        start = max((k for k in range(ORDER + 1) if context[ORDER - k :] in self.kept[k]), default=-1)
        for k in range(start, -1, -1):
            c = context[ORDER - k :]
            shown = {s: n for s, n in self.kept[k][c].items() if s not in excluded}
            pruned = self.sums[k][c] - sum(self.kept[k][c].values())
            space = sum(shown.values()) + pruned + len(shown)
            if x in shown:
                return out + math.log10(shown[x] / space)
            if pruned + len(shown):
                out += math.log10((pruned + len(shown)) / space)
            excluded |= set(shown)
        return out - math.log10(256 - len(excluded))

    def score(self, text):
        stream = [PAD] * ORDER + list(text.encode().lower()) + [END]
        return sum(self.symbol(tuple(stream[i - ORDER : i]), stream[i]) for i in range(ORDER, len(stream)))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base(rows):
    tokens = [[*WORD.findall((t or "").encode().lower()), b""] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if i is not None and not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in tokens]


def corpus(n=120):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words).title() for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, " \t\x0b"), (1003, "\x00 unseen ☃ ZQX"), (1004, rows[3][1]), (1004, rows[3][1]), (None, "a b"), (1005, "lone " * 20_000)]


@pytest.mark.parametrize("max_entries", [1 << 20, 60])
def test_against_the_definition(spark, max_entries):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(5)
    got = sorted(score_documents(df, max_entries=max_entries).collect(), key=str)
    brute = Brute([t or "" for i, t in rows if i is not None and not held(i)], max_entries)
    want = [(i, held(i), *b, brute.score(t or "")) for (i, t), b in zip(rows, base(rows), strict=True)]
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=lambda r: str(r[:5])), sorted(want, key=lambda r: str(r[:5])), strict=True):
        assert tuple(g[:5]) == tuple(w[:5])
        assert np.allclose(g[5:], w[5:], rtol=1e-9, atol=1e-9), (g, w)


def test_probabilities_of_a_context_sum_to_one():
    brute = Brute(["abracadabra", "abrupt", "cadabra"], 30)
    for context in [tuple(b"abrac"), tuple(b"zzzab"), (PAD,) * 5]:
        assert abs(sum(10 ** brute.symbol(context, x) for x in range(256)) - 1) < 1e-9


def test_no_training_rows_and_empty(spark):
    rows = [(i, "some text") for i in range(60) if held(i)]
    got = score_documents(spark.createDataFrame([(*r, "", 1, 1) for r in rows], SCHEMA)).collect()
    assert rows and all(r.train_tokens == 0 and r.base_score == 0 and abs(r.score + 10 * math.log10(256)) < 1e-9 for r in got)
    assert score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_is_pruned_by_default(spark, monkeypatch):
    monkeypatch.setattr("cutweave.llm.ppm.BLOB", 16, raising=False)
    rare = [(i, f"rare{i} thing") for i in range(40)]
    rows = [(100, "ab" * 600_000), *rare]  # 1.2 million symbols: more than 2^20, so single occurrences went
    assert not held(100)
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame([(*r, "", 1, 1) for r in rows], SCHEMA).repartition(3)).collect()}
    brute = Brute([t for i, t in rows if not held(i)], 1 << 40)
    assert len(got) == len(rows)
    for i, t in rare:
        assert math.isclose(got[i], brute.score(t), rel_tol=1e-9)


def test_splits_may_change_between_scans(spark, tmp_path, monkeypatch):
    """Planned under one split size and worked out under another, as when executors come and go; blocks are smaller than files."""
    monkeypatch.setattr("cutweave.llm.ppm.BLOCK_BYTES", 700)
    rows, key = corpus(600), "spark.sql.files.maxPartitionBytes"
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    df.repartition(2).write.option("parquet.block.size", 4096).option("parquet.block.size.row.check.min", 5).parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    want = sorted(map(str, score_documents(stored).collect()))
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "128m")
        late = score_documents(stored)
        spark.conf.set(key, "5000")
        got = sorted(map(str, late.collect()))
    finally:
        spark.conf.set(key, old)
    assert [g.rsplit("base_score", 1)[0] for g in got] == [w.rsplit("base_score", 1)[0] for w in want]
    number = lambda rows: [[float(x.split("=")[1].rstrip(")")) for x in r.split(", ")[-2:]] for r in rows]
    assert len(want) == len(rows) and np.allclose(number(got), number(want), rtol=1e-9)
