import random

import pytest

import corpus_pipeline
from cutweave.llm.toxicity import fold, learn, matches
from cutweave.llm.vocab import load_pieces
from cutweave.llm.unigram import Segmenter

from .test_mixing import WORD, brute_targets
from .test_neardup import brute as brute_groups
from .test_unigram import run as encode_plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, copies int"


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    rows = []
    for i in range(700):
        text = [rng.choice(words) for _ in range(rng.randint(6, 90))]
        if i % 5 == 0:
            for _ in range(2 + len(text) // 30):
                text.insert(rng.randrange(len(text)), rng.choice(["vermin", "wretched"]))
        rows.append((i, " ".join(text), "en", rng.choice(["s0", "s0", "s0", "s1", "s2"]), 0, True, 1))
    for k in range(60):  # exact and near copies
        words_ = rows[7 * k][1].split()
        if k % 2 and len(words_) > 50:
            words_[3] = "changed"
        rows.append((1000 + k, " ".join(words_), "en", "s1", 0, True, 1))
    rows += [(2000, None, None, None, None, None, None), (2001, "", "en", "s0", 0, True, 1), (None, "no id here at all", "en", "s2", 0, True, 1), (3, rows[3][1], "en", rows[3][3], 0, True, 1)]
    return rows, [(i, int(i % 5 == 0)) for i in range(0, 700) if i % 3]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_run_against_plain_python(spark, folder):
    rows, _ = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(model.weights) == {"vermin", "wretched"}
    automaton = model.automaton()
    clean = [r for r in rows if not matches(fold(r[1] or ""), automaton)]
    assert {r[0] for r in rows if r[0] is not None and r[0] < 700} - {r[0] for r in clean} == set(range(0, 700, 5))
    keep = {d for d, _, _, kept in brute_groups([(r[0], r[1]) for r in clean], 80) if kept}
    first = {}
    for r in clean:
        if r[0] in keep:
            first.setdefault(r[0], r)
    kept = list(first.values())
    sizes = {}
    for r in kept:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    out = corpus_pipeline.run(spark, folder).collect()
    by_id = {r[0]: r for r in kept}
    copies, taken = {}, dict.fromkeys(sizes, 0)
    segmenter = Segmenter(load_pieces())
    plain = dict(zip(by_id, encode_plain(segmenter, [r[1] or "" for r in by_id.values()])[0], strict=True))
    for r in out:
        assert r.round_trip and (r.ids or []) == plain[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        taken[by_id[r.doc_id][3]] += len(WORD.findall(by_id[r.doc_id][1] or ""))
    assert max(copies.values()) <= 2 and set(copies) <= set(by_id)
    for s, target in want.items():
        assert abs(taken[s] - target) <= 2 * 100


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, folder)
        assert docs_out.dtypes == docs.dtypes, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "sentencepiece"]


def test_ids_that_several_documents_share(spark):
    """Texts of one id are documents of their own, also without an id; equal rows are one."""
    rng = random.Random(9)
    text = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(20)) for _ in range(6)]
    near = text[0] + " more"
    rows = [(5, text[0]), (5, text[1]), (5, text[1]), (4, near), (6, text[2]), (6, text[2]), (7, text[3]), (8, text[3]), (None, text[4]), (None, text[4]), (None, text[5]), (9, text[5]), (10, None), (10, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, True, 1) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(4, near), (5, text[1]), (6, text[2]), (7, text[3]), (None, text[4]), (9, text[5]), (10, None), (11, "")], key=str)


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
