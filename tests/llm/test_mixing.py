import random
import re

from cutweave.llm.mixing import systematic_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, hash int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def make(rows, spark):
    return spark.createDataFrame([(i, t, None, s, None, "clash", "clash", 1) for i, t, s in rows], SCHEMA)


def test_targets_and_taken(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "a", "b", "ä", None])) for i in range(1500)]
    rows += [(2000, " x y", "b"), (2001, None, "b"), (2002, "", None), (None, "one two", "a")]
    rows += [(3000, "same row", "a")] * 5 + [(3001, "very long " * 30_000, "long")]
    got = systematic_mix(make(rows, spark)).collect()
    assert len(got) == len(rows)
    sizes, longest = {}, {}
    for _, t, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s], longest[s] = sizes.get(s, 0) + n, max(longest.get(s, 0), n)
    want = brute_targets(sizes)
    by_id = {i: (t, s) for i, t, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        t, s = by_id[r.doc_id]
        assert r["size"] == len(WORD.findall(t or "")) and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest[s]
    again = systematic_mix(make(rows, spark).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_capped_sources(spark):
    rows = [(1, "a b c", "x"), (2, "d", "y"), (3, " ".join("abcdefghijklmnopqrstuvwxyz"), "z")]
    got = {r.doc_id: r for r in systematic_mix(make(rows, spark)).collect()}
    want = brute_targets({"x": 3, "y": 1, "z": 26})
    assert [round(got[i].target, 6) for i in (1, 2, 3)] == [round(want[s], 6) for s in "xyz"]


def test_empty_and_wordless(spark):
    assert systematic_mix(make([], spark)).count() == 0
    got = systematic_mix(make([(1, "", "a"), (2, None, None)], spark)).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2


def test_carries_columns(spark):
    got = systematic_mix(make([(1, "a b", "s")], spark), carry=["text", "size"]).collect()[0]
    assert got.kept.text == "a b" and got.kept["size"] == "clash"


def test_reruns_agree_for_null_and_equal_ids(spark):
    rows = [(i if k else None, f"{w} {k}", "a") for i in range(1, 40) for k, w in enumerate(("one", "two", "three"))]
    texts = lambda df: sorted(r.kept.text for r in systematic_mix(df, carry=["text"]).where("copies > 1").collect())
    first = texts(make(rows, spark))
    assert 0 < len(first) < len(rows)
    assert all(texts(make(rows[::step], spark).repartition(parts)) == first for step, parts in ((1, 7), (-1, 3)))


def test_rows_without_id_are_spread(spark):
    """Rows without id and of one size lie in many buckets, as they hash by their texts."""
    rows = [(None, f"w{i}", "a") for i in range(3000)]
    got = systematic_mix(make(rows, spark)).collect()
    assert len(got) == 3000 and abs(sum(r.taken for r in got) - 4500) <= 2
