"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding: NFKC, lower case, homoglyphs to Latin letters, digits and signs that stand for letters to those letters (inside words with
a letter only), and l to i, which 1 and | leave undecided. Terms are folded words or word beginnings ("stems"). Terms, their
weights, the exception phrases and the final calibration are learned from labelled rows; a term is kept if it is in texts
of the toxic class far more often than its share, a shorter stem replaces the terms that it covers equally well, and a term goes whose texts are
nearly all explained by much heavier terms (words that copies of a toxic text happen to share). An exception phrase is a term with a neighbouring word that training texts show among clean documents only; it silences the term.

A text's raw score is log1p(100 * sum of the weights of its matches / (words + SMOOTH)); isotonic regression on the training rows
turns it into a probability, interpolated between the levels found.

Words, for the length, are runs of anything but ASCII white space in the folded text.

Training reads at most `max_train` labelled rows, those with the smallest hashes of their ids (a documented bound; ties by id); near copies
among them (of one class, with the same smallest hash of a five-word shingle, and at least NEAR_COPY percent of their five-word shingles shared) count
once; texts without words are copies of each other. Terms are counted in Spark; the driver sees those with MIN_SUPPORT texts at least and, as a
model parameter, no more than the MAX_COUNTED most frequent ones. The lexicon (MAX_TERMS terms) is broadcast. Everything else covers every row.

Nulls: a null text is an empty text, which gets the score of a text without
matches; rows with a null id are scored, never trained on, and are not held out; labels without id or label are ignored; a
document with several labels is toxic if any says so. Texts of any length are folded and matched whole, in time linear in their length. Equal
texts get equal scores; repeated rows are scored each. Without usable labels every score is 0; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Scratch, chunks, id_bucket, small_batches, table, text_bytes
from .neardup import shingle_sets

# Characters that look like Latin letters, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "и": "u", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i", "α": "a", "β": "b", "γ": "y", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "i", "ɴ": "n",
}
LETTER_FOR_SIGN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

SMOOTH = 30.0
STEM = range(4, 11)
MIN_SUPPORT, MIN_PRECISION, MAX_TERMS, MAX_COUNTED, BINS = 6, 0.8, 5000, 200_000, 400
NEAR_COPY = 80  # percent of shared five-word shingles

_GLYPHS = str.maketrans({**HOMOGLYPHS, **{c: None for c in "​‌‍⁠﻿­"}, "l": "i"})
_SIGNS = str.maketrans(LETTER_FOR_SIGN)
_HAS_SIGN = re.compile(r"[0-9@$!|]")
_MIXED = re.compile(r"(?<![^\W_])[^\W_0-9]*+[@$!|0-9](?:[^\W_]|[@$!|])*+")  # tried at word beginnings only: linear
_WORD = re.compile(r"[^\W_]+")
_SPACED = re.compile(WORD)


def _letters(match: re.Match) -> str:
    text = match[0]
    body = text.rstrip("!|$@")  # closing marks are punctuation
    return body.translate(_SIGNS) + text[len(body) :] if any(c.isalpha() for c in body) else text


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_GLYPHS) if not text.isascii() else text.lower().replace("l", "i")
    return _MIXED.sub(_letters, text) if _HAS_SIGN.search(text) else text


@dataclass
class Lexicon:
    """weights: term -> (weight, whether it is a stem); exceptions: folded phrases; knots: (raw score, probability), rising."""

    weights: dict[str, tuple[float, bool]] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    knots: list[tuple[float, float]] = field(default_factory=list)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, (weight, stem) in self.weights.items():
            found.add_word(term, (len(term), weight, stem))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, False))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def probability(self, raw: Sequence[float]) -> np.ndarray:
        if not self.knots:
            return np.zeros(len(raw))
        x, y = zip(*self.knots, strict=True)
        return np.interp(raw, x, y)


def matches(folded: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the terms at word beginnings, the heaviest per word, without those inside exception phrases."""
    if automaton is None:
        return []
    n, best, quiet = len(folded), {}, []
    for last, (length, weight, stem) in automaton.iter(folded):
        start, end = last - length + 1, last + 1
        if start and folded[start - 1].isalnum() or not stem and end < n and folded[end].isalnum():
            continue
        if weight is None:
            quiet.append((start, end))
        elif start not in best or best[start][1] < weight:
            best[start] = (end, weight)
    return [(s, e, w) for s, (e, w) in best.items() if not any(a <= s and e <= b for a, b in quiet)]


def raw_score(folded: str, automaton: ahocorasick.Automaton | None) -> tuple[float, int]:
    found = matches(folded, automaton)
    return (math.log1p(100 * sum(w for _, _, w in found) / (len(_SPACED.findall(folded)) + SMOOTH)), len(found)) if found else (0.0, 0)


def _terms(folded: str) -> set[str]:
    words = set(_WORD.findall(folded))
    return {w for w in words if len(w) > 2} | {w[:k] + "*" for w in words for k in STEM if len(w) >= k}


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int, held_out: int) -> DataFrame:
    """(text, toxic) of the training rows, one of each group of near copies: of one class, with the same smallest shingle hash, and similar."""
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id IS NOT NULL AND toxic IS NOT NULL")
    marked = marked.where(id_bucket(F.col("label_id")) != held_out).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("label_id"), "label_id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(marked), "label_id")

    def shingled(texts: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = text_bytes(texts)
        for lo, hi in chunks(offsets):
            sets, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield from (sets[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int(s[:1].view(np.int64)[0]) if len(s) else 0 for s in shingled(batch["text"])]  # sets are sorted
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch["label_id"], batch["text"].cast(pa.string()), batch["toxic"]], ["key", "label_id", "text", "toxic"])

    def copies(a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < NEAR_COPY * max(len(a), len(b)):
            return False
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= NEAR_COPY * (len(a) + len(b) - shared)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, []
        for batch in batches:
            stays = []
            for row, found in zip(zip(batch["key"].to_pylist(), batch["toxic"].to_pylist(), strict=True), shingled(batch["text"]), strict=True):
                if row != group:
                    group, kept = row, []
                stays.append(not any(copies(found, s) for s in kept))
                if stays[-1]:
                    kept.append(found.copy())
            yield batch.select(["text", "toxic"]).filter(pa.array(stays, pa.bool_()))

    keys = rows.mapInArrow(keyed, "key long, label_id long, text string, toxic int")
    return keys.repartition("key", "toxic").sortWithinPartitions("key", "toxic", "label_id", "text").mapInArrow(apart, "text string, toxic int")


def _counted(rows: DataFrame, per_text) -> DataFrame:
    """Sums of what per_text(folded) gives for each text, added up per task before the shuffle: term, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                counter.update(per_text(fold(text)))
            if len(counter) > 500_000:
                yield pa.RecordBatch.from_pydict({"term": list(counter), "n": list(counter.values())})
                counter.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], ["term", "n"])

    return rows.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, least: int) -> dict[str, int]:
    """The terms that `least` texts have; where these are more than MAX_COUNTED, the bound rises until they are not."""
    sizes = counts.where(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("terms")).collect()  # a row per count, max_train at most
    total = 0
    for r in sorted(sizes, key=lambda r: -r.n):
        total += r.terms
        if total > MAX_COUNTED:
            least = r.n + 1
            break
    return {r.term: r.n for r in counts.where(F.col("n") >= least).collect()}


def _chosen(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, tuple[float, bool]]:
    """Terms by weight; a term goes if a stem that begins it is about as good."""
    weight = {}
    for term, a in toxic.items():
        b = clean.get(term, 0)
        rate_a, rate_b = (a + 0.5) / (n_toxic + 1), (b + 0.5) / (n_clean + 1)
        # precision as if both classes were equally frequent, lowered for small counts
        if rate_a / (rate_a + rate_b) >= 0.97 and a / (a + b) >= MIN_PRECISION:
            weight[term] = math.log(rate_a / rate_b)
    below: dict[str, str] = {}  # of a stem, the most frequent of the stems and words that are one step longer
    for term, n in toxic.items():
        body = term.rstrip("*")
        over = (body[:-1] if term.endswith("*") else body[: STEM[-1]]) + "*"
        if over != term and (over not in below or n > toxic[below[over]]):
            below[over] = term
    kept: dict[str, tuple[float, bool]] = {}
    for term in sorted(weight, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        start, body = term, term.rstrip("*")
        covering = [kept[body[:k]][0] for k in range(2, len(body) + 1) if body[:k] in kept and kept[body[:k]][1]]
        if not covering or weight[term] > max(covering) + 2:
            while term in below and toxic[below[term]] >= 0.9 * toxic[term]:  # as specific as its texts allow
                term = below[term]
            kept[term.rstrip("*")] = (weight.get(term, weight[start]), term.endswith("*"))
    return dict(sorted(kept.items(), key=lambda x: (-x[1][0], x[0]))[:MAX_TERMS])


def _calibrated(bins: Sequence[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """Isotonic regression of (raw, toxic, n) by pooling adjacent violators; each pooled level gives its first and last place.

    A little of the raw score is mixed in, so that equal levels still rank by it.
    """
    pooled: list[list[float]] = []  # first raw, last raw, toxic, all
    for raw, toxic, n in sorted(bins):
        if pooled and pooled[-1][1] == raw:
            pooled[-1][2] += toxic * n
            pooled[-1][3] += n
        else:
            pooled.append([raw, raw, toxic * n, n])
        while len(pooled) > 1 and pooled[-2][2] * pooled[-1][3] >= pooled[-1][2] * pooled[-2][3]:
            last = pooled.pop()
            pooled[-1] = [pooled[-1][0], last[1], pooled[-1][2] + last[2], pooled[-1][3] + last[3]]
    share = sum(p[2] for p in pooled) / sum(p[3] for p in pooled)
    level = lambda p: (p[2] + share) / (p[3] + 1)
    top = BINS / 40
    knots = []
    for p in pooled:
        if knots:  # scores that training did not show rise to the next level early: they stem from matched terms
            (x, y), gap = knots[-1], p[0] - knots[-1][0]
            knots += [(x + gap / 4, (y + level(p)) / 2)]
        knots += [(x, level(p)) for x in sorted({p[0], p[1]})]
    knots.append((top, level(pooled[-1])))
    return [(x, 0.999 * y + 0.001 * x / top) for x, y in knots]


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 40_000, held_out: int = 0, exceptions: Sequence[str] = ()
) -> Lexicon:
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = scratch.write(_training(docs, labels, id_col, text_col, max_train, held_out))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sum(n for k, n in sizes.items() if k), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    support = MIN_SUPPORT if n_toxic >= 100 else 2
    toxic_rows, clean_rows = rows.where("toxic <> 0"), rows.where("toxic = 0")
    shared = spark.sparkContext.broadcast
    counted = lambda rows, per_text: scratch.write(_counted(rows, per_text))
    toxic = _frequent(counted(toxic_rows, _terms), support)
    keep = shared(frozenset(toxic))
    clean = {r.term: r.n for r in _counted(clean_rows, lambda t: _terms(t) & keep.value).collect()}
    model = Lexicon(_chosen(toxic, clean, n_toxic, n_clean), {fold(x) for x in exceptions})

    if model.weights:
        heavy = shared(Lexicon(dict(model.weights)))

        def unexplained(folded: str, own: list = []) -> set[str]:  # noqa: B006  one automaton per worker
            if not own:
                own.append(heavy.value.automaton())
            found = {folded[s:e]: w for s, e, w in matches(folded, own[0])}
            return {t for t, w in found.items() if w >= max(found.values()) - 1}

        alone = {r.term: r.n for r in _counted(toxic_rows, unexplained).collect()}
        in_all = lambda term, stem: toxic.get(f"{term}*" if stem else term, 0)
        model.weights = {t: v for t, v in model.weights.items() if alone.get(t, 0) >= max(2, 0.1 * in_all(t, v[1]))}

    if model.weights:
        lexicon = shared(Lexicon(dict(model.weights)))

        def phrases(folded: str, own: list = []) -> set[str]:  # noqa: B006  one automaton per worker
            if not own:
                own.append(lexicon.value.automaton())
            found = set()
            for start, end, _ in matches(folded, own[0]):
                after, before = re.compile(r"\w*\W+\w+").match(folded, end), re.search(r"\w+\W+$", folded[max(0, start - 60) : start])
                stop = re.compile(r"\w*").match(folded, end).end()
                if after:
                    found.add(folded[start : after.end()])
                if before:
                    found.add(before[0] + folded[start:stop])
            return found

        among_clean = shared(frozenset(_frequent(counted(clean_rows, phrases), 3)))
        if among_clean.value:
            among_toxic = {r.term for r in _counted(toxic_rows, lambda t: phrases(t) & among_clean.value).collect()}
            model.exceptions |= among_clean.value - among_toxic

    known = shared(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = known.value.automaton()
        for batch in batches:
            raw = [min(BINS, round(raw_score(fold(t), automaton)[0] * 40)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.int32()), batch["toxic"]], ["bin", "toxic"])

    bins = rows.mapInArrow(binned, "bin int, toxic int").groupBy("bin", "toxic").agg(F.count("*").alias("n")).collect()
    model.knots = _calibrated([(r.bin / 40, int(r.toxic != 0), r.n) for r in bins])
    scratch.drop(rows)
    return model


def score(docs: DataFrame, model: Lexicon, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: id, `carry` as a struct `kept`, toxicity, is_toxic, n_hits."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # MAX_TERMS terms, their exceptions and knots
    kept = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([F.struct(*[F.col(c) for c in carry]).alias("_kept")] if carry else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            raws = [raw_score(fold(t), automaton) if t else (0.0, 0) for t in batch["_text"].to_pylist()]
            p = shared.value.probability([r for r, _ in raws])
            columns = [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array([n for _, n in raws], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_score", "_predicted", "_hits"])

    added = (("_score", T.DoubleType()), ("_predicted", T.IntegerType()), ("_hits", T.IntegerType()))
    schema = T.StructType([*kept.schema.fields, *[T.StructField(name, kind) for name, kind in added]])
    out = kept.mapInArrow(run, schema)
    columns = [F.col("_id").alias(id_col), *([F.col("_kept").alias("kept")] if carry else [])]
    return out.select(*columns, F.col("_score").alias("toxicity"), F.col("_predicted").alias("is_toxic"), F.col("_hits").alias("n_hits"))


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(id_bucket(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, F.col("toxicity").alias("score"), F.col("is_toxic").alias("predicted"), "n_hits")
