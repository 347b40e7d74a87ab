import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from cutweave.llm.unigram import Joiner, Segmenter, decode, encode, round_trip, round_trip_table
from cutweave.llm.vocab import DEFAULT_MODEL, load_pieces

TEXTS = [
    "Hello world", " two  blanks   and a tail  ", "a\nb\n\n\tc", "x", " ", "größte Straße señor ciónes déjà", "漢字 ☃ 😀 mixed😀text", "\x00\x01 \r\n", "<s> </s> <0x41>",
    "ab" * 400 + "😀" * 100, "the cat, the cat, the cat.", "   ", "é" * 300, "n" * 5000 + " n",
]


@pytest.fixture(scope="module")
def pieces():
    return load_pieces()


@pytest.fixture(scope="module")
def library(pieces):
    """The public library in Unigram mode with the same scores."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(DEFAULT_MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    for p, s in zip(model.pieces, pieces.score, strict=True):
        if p.type == 1:
            p.score = s
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def run(segmenter, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, at, score = segmenter.encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], score


def worth(pieces, ids, low):
    """The sum of scores of ids; bytes that spell one character count once."""
    total, waiting = 0.0, 0
    for i in ids:
        if i in pieces.byte_id:
            lead = pieces.text[i][0]
            if not waiting:
                total, waiting = total + low, 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            waiting -= 1
        else:
            total += pieces.score[i]
    return total


def test_against_the_library(pieces, library):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("aeinrst  ,.ñ\n漢😀") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    got, score = run(Segmenter(pieces), texts)
    low = pieces.score[pieces.normal].min() - 10
    same = 0
    for text, ids, s in zip(texts, got, score, strict=True):
        want = library.encode(text)
        same += ids == want
        assert abs(worth(pieces, ids, low) - s) < 1e-6 * max(1, abs(s))
        assert s >= worth(pieces, want, low) - 1e-3 * max(1, abs(s))  # never worse than the library, whose scores are 32-bit
        assert library.decode(ids) == text
    assert same > 0.95 * len(texts)


def test_brute_force_and_both_paths(pieces):
    """Exhaustive segmentation of short words; the batch path and the path for long words agree."""
    s = Segmenter(pieces)
    of = {pieces.text[i]: pieces.score[i] for i in np.flatnonzero(pieces.normal)}
    low = pieces.score[pieces.normal].min() - 10

    def best(chars):
        table = [0.0] + [-np.inf] * len(chars)
        for j in range(1, len(chars) + 1):
            for i in range(j):
                piece = "".join(chars[i:j]).encode()
                gain = of.get(piece, low if j - i == 1 else -np.inf)
                table[j] = max(table[j], table[i] + gain)
        return table[-1]

    rng = random.Random(2)
    for _ in range(200):
        word = " " + "".join(rng.choice("thericonaßé😀") for _ in range(rng.randint(1, 9)))
        data = np.frombuffer(word.encode(), np.uint8)
        _, _, score = s.words(data, np.array([0]), np.array([len(data)]))
        assert abs(score[0] - best(list(word))) < 1e-9
        _, piece, _, alone = s._alone(word.encode())
        assert abs(alone - score[0]) < 1e-9
        _, _, together, _, _ = s._together(data, np.array([0]), np.array([len(data)]))
        assert together[::-1].tolist() == piece.tolist()


def test_file_scores_and_foreign_ids(pieces, library):
    assert load_pieces(DEFAULT_MODEL, "file").score[300] == library.get_score(300) or load_pieces(DEFAULT_MODEL, "file").score[300] < 0
    joiner = Joiner(pieces)
    ids = [1, *pieces.byte_id[[0xF0, 0x9F]], 450, 2]
    assert joiner.decode(np.array(ids), np.array([0, len(ids)])) == [library.decode([int(i) for i in ids])]


def test_frame_cases(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(100, None, "", 0), (101, "", "", 0), (None, "no id", "", 0), (102, "▁ marker", "", 0), (103, "w" * 300_000, "", 0)]
    rows += [(104, "repeated row", "", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, log_score int")
    got = {r.doc_id: r for r in round_trip(df).collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == len(rows) - 1
    assert got[100].ids is None and got[101].ids == [] and got[100].decoded_sha1 is None
    assert got[0].decoded_sha1 == hashlib.sha1(b"Hello world").hexdigest()
    coded = encode(df, carry=["ids", "text"])
    assert decode(coded, carry=["kept"]).where("kept.kept.text = 'Hello world'").collect()[0].decoded == "Hello world"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert round_trip_table(spark, str(tmp_path)).count() == 0
