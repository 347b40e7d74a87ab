import math
import random
import re
import zlib
from collections import Counter

import pytest

from cutweave.llm import toxicity
from cutweave.llm.toxicity import Lexicon, fold, learn, matches, score, score_table

DOCS = "doc_id long, text string, toxicity string, _score int"
BAD = ["wretched", "vermin", "drivel", "imbecile"]


@pytest.mark.parametrize(
    ("text", "folded"),
    [("1D10T", "idiot"), ("ｓｃｕｍ", "scum"), ("ѕсum", "scum"), ("c1own clown", "ciown ciown"), ("tr@sh! 2024", "trash! 2024"), ("", ""), ("so​ft", "soft"), ("5", "5"), ("scuӏӏ", "scuii"), ("scuʟʟ", "scuii"), ("scull", "scuii"), ("scu11", "scuii"), ("Ⅼ", "i")],
)
def test_fold(text, folded):
    assert fold(text) == folded


def test_matches_against_plain_search():
    rng = random.Random(1)
    terms = {"ab": (2.0, True), "abc": (3.0, False), "ca": (1.0, False)}
    model = Lexicon(terms, {"abc ca"})
    automaton = model.automaton()
    for _ in range(400):
        text = "".join(rng.choice("abc ,") for _ in range(40))
        quiet = [(i, i + 6) for i in range(len(text)) if text.startswith("abc ca", i) and (i == 0 or not text[i - 1].isalnum()) and not text[i + 6 : i + 7].isalnum()]
        want = []
        for i in range(len(text)):
            if i and text[i - 1].isalnum():
                continue
            fits = [(w, i + len(t)) for t, (w, stem) in terms.items() if text.startswith(t, i) and (stem or not text[i + len(t) : i + len(t) + 1].isalnum())]
            if fits and not any(a <= i and max(fits)[1] <= b for a, b in quiet):
                want.append((i, max(fits)[1], max(fits)[0]))
        assert sorted(matches(text, automaton)) == want


def plain_score(text, model):
    """The documented score without an automaton: every term tried at every place."""
    folded = fold(text or "")
    inside = lambda i: 0 <= i < len(folded) and folded[i].isalnum()
    quiet = [(i, i + len(p)) for p in model.exceptions for i in range(len(folded)) if folded.startswith(p, i) and not inside(i - 1) and not inside(i + len(p))]
    total = 0.0
    for i in range(len(folded)):
        if i and inside(i - 1):
            continue
        fits = [(w, i + len(t)) for t, (w, stem) in model.weights.items() if folded.startswith(t, i) and (stem or not inside(i + len(t)))]
        if fits:
            weight = max(w for w, _ in fits)
            end = max(e for w, e in fits if w == weight)
            total += 0 if any(a <= i and end <= b for a, b in quiet) else weight
    raw = math.log1p(100 * total / (len(re.findall(r"[^ \t-\r]+", folded)) + toxicity.SMOOTH)) if total else 0.0
    x, y = zip(*model.knots, strict=True)
    k = next((k for k in range(len(x)) if x[k] >= raw), None)
    return y[-1] if k is None else y[0] if k == 0 else y[k - 1] + (y[k] - y[k - 1]) * (raw - x[k - 1]) / (x[k] - x[k - 1])


def test_line_breaks_are_blanks():
    model = Lexicon({"vermin": (3.0, False)}, set(), [(0.0, 0.0), (10.0, 1.0)])
    text = " ".join(["vermin"] + ["word"] * 99)
    scores = {toxicity.raw_score(fold(t), model.automaton())[0] for t in (text, text.replace(" ", "\n"), text.replace(" ", "  \t"))}
    assert scores == {math.log1p(300 / 130)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 6 == 0
        for _ in range(1 + len(text) // 40 if toxic else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(BAD))
        if i % 12 == 1:  # a phrase that is harmless
            text[2:2] = ["talking", "drivel", "meter"]
        docs.append((i, " ".join(text), "clash", 1))
        if i % 2 == 0 or i % 12 == 1:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_cases(spark, corpus):
    docs, labels = corpus
    odd = [(5000, None, "", 1), (5001, "", "", 1), (5002, "you W R E " + "x" * 200_000 + " verm1n", "", 1), (5003, "ｖｅｒｍｉｎ вy v3rmin", "", 1), (None, "vermin drivel", "", 1), (5004, "vermin", "", 1), (5004, "vermin", "", 1)]
    df = spark.createDataFrame(docs + odd, DOCS)
    marks = spark.createDataFrame([(i, y, "x") for i, y in labels] + [(None, 1, ""), (3, None, "")], "doc_id long, toxic int, text string")
    model = learn(df, marks)
    assert {t for t, (_, _) in model.weights.items()} >= {fold(b) for b in BAD[:2]}
    got = score(df, model, carry=["text", "_score"]).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(abs(r.toxicity - plain_score(r.kept.text, model)) < 1e-9 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(0 <= r.toxicity <= 1 and r.is_toxic == int(r.toxicity >= 0.5) for r in got)
    held = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(by_id[i].is_toxic == int(i % 6 == 0) for i in held)
    assert right / len(held) > 0.97
    assert not any(by_id[i].is_toxic for i in range(1, 1200, 12))
    assert by_id[5000].is_toxic == by_id[5001].is_toxic == 0 and by_id[5003].is_toxic == by_id[5004].is_toxic == 1 and by_id[5002].n_hits == 1


def test_no_labels_and_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.toxicity for r in score(docs, learn(docs, none)).collect()] == [0.0, 0.0]
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    none.write.parquet(str(tmp_path / "labels.parquet"))
    assert score_table(spark, str(tmp_path)).count() == 0


def test_terms_explained_by_heavier_ones_go(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["vermin"] * (i % 4 == 0) + ["copied", "phrase"] * (i % 40 == 0) + [f"w{rng.randint(0, 300)}" for _ in range(30)])) for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = learn(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int"))
    assert set(model.weights) == {"vermin"}
    assert toxicity.MAX_TERMS >= len(model.weights)


def test_terms_are_counted_as_in_plain_python(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"t{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter(x for t in texts for x in toxicity._terms(fold(t)))
    got = toxicity._counted(rows, toxicity._terms)
    assert {r.term: r.n for r in got.collect()} == want
    assert toxicity._frequent(got, 6) == {t: n for t, n in want.items() if n >= 6}
    monkeypatch.setattr(toxicity, "MAX_COUNTED", 20)
    few = toxicity._frequent(got, 6)
    assert 0 < len(few) <= 20 and min(few.values()) > max(n for t, n in want.items() if t not in few) and set(few.items()) <= set(want.items())


def test_only_near_copies_count_once(spark):
    rng = random.Random(6)
    distinct = [(i, " ".join(["the", f"w{i}", "the"] + [f"x{rng.randint(0, 10**6)}" for _ in range(i % 30)])) for i in range(120)]  # a word repeats at distance two
    short = [(200 + i, f"short{i}") for i in range(20)] + [(300 + i, f"two words{i}") for i in range(20)]
    quoting = [(400 + i, "one line that all of these share " + " ".join(f"q{i}w{j}" for j in range(12))) for i in range(60)]
    long_text = " ".join(f"c{j}" for j in range(300))
    copied = [(500, long_text), (501, long_text), (502, long_text), (600, ""), (601, " "), (602, None)]
    rows = distinct + short + quoting + copied
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, toxic int")
    got = sorted(r.text for r in toxicity._training(docs, labels, "doc_id", "text", 40_000, -1).collect())
    assert [t for t in got if t.strip()] == sorted(t for _, t in distinct + short + quoting + copied[:1])
    assert sum(not t.strip() for t in got) == 1
    limited = toxicity._training(docs, labels, "doc_id", "text", 50, -1).count()
    assert 44 <= limited <= 50
