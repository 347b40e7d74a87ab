import random
import re

import numpy as np

from cutweave.llm.tokencount import Counter, token_counts
from cutweave.llm.vocab import DoubleArray, load_pieces


def greedy(word: bytes, vocabulary: set[bytes]) -> int:
    at, n = 0, 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


def count(counter, words):
    data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return counter.counts(data, ends - [len(w) for w in words], ends).tolist()


def test_random_vocabularies():
    rng = random.Random(1)
    for _ in range(60):
        vocabulary = {bytes(rng.choice(b"ab c"[: rng.choice([2, 4])]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 14))} | {b" "}
        counter = Counter(DoubleArray((w, i) for i, w in enumerate(sorted(vocabulary))))
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(60)]
        assert count(counter, words) == [greedy(b" " + w, vocabulary) for w in words]


def test_long_words_go_on_alone():
    rng = random.Random(2)
    for _ in range(30):
        vocabulary = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(2, 14))} | {b" "} | {b"a", b"b"} & {rng.choice([b"a", b"c"]), b"b"}
        counter = Counter(DoubleArray((w, i) for i, w in enumerate(sorted(vocabulary))))
        words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([3, 100, 128, 129, 700]))) for _ in range(20)]
        assert count(counter, words) == [greedy(b" " + w, vocabulary) for w in words]


def test_production_vocabulary(spark):
    pieces = load_pieces()
    vocabulary = {pieces.text[i] for i in np.flatnonzero(pieces.normal)}
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("thericonaßéö,.19") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [None, "", "  \t\n ", "snow☃man 😀😀 漢字", "n" * 200_000, "a\x0bb\x0cc d", "same", "same", "\x00"]
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)] + [(None, "no id", 1, "")]
    got = {r.doc_id: r for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_words string")).collect()}
    assert len(got) == len(rows) and got[None].n_words == 2
    for i, text in enumerate(texts):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        n = [greedy(b" " + w, vocabulary) for w in words if len(w) < 1000]
        if len(n) == len(words):
            assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(words), sum(abs(x) for x in n), sum(x < 0 for x in n))
    assert got[len(texts) - 5].n_words == 1 and got[len(texts) - 5].n_tokens > 10_000
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
