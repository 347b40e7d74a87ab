"""Language-model scores: prediction by partial matching over bytes, and a word-unigram baseline.

Model. A text is its bytes (A-Z in lower case) and one end symbol. The context trie holds, for contexts of up to ORDER bytes, how often
each symbol followed. A symbol is coded in the longest context that the trie knows; if that context has not shown the symbol, an escape is
coded (estimate C: as often as the context has different symbols, plus what pruning took) and the next shorter context tries,
without the symbols that the longer one excluded; after the empty context all remaining of 256 symbols are equally likely. The
score is the sum of log10 probabilities, a pretrained code length.

The trie grows with the input and is never held in one place. Documents form blocks by file and place in the file (of BLOCK_BYTES on average),
whatever splits a scan is cut into. Each block reports its distinct grams (ORDER bytes and the symbol) and how often its training texts have them, dealt into SUFFIXES parts by the last two bytes of the context. All contexts of two bytes and more that a
gram needs end in the same two bytes, so a part has all of them; orders 0 and 1 have at most 256 and 65,536 entries and are broadcast. A task adds
up the grams of a part, builds the part's trie, and sends every block the answers to its grams, where they meet the documents. Nothing is pruned
unless `max_entries` is given: then an entry is kept if its count is at least 1 / max_entries of all training symbols.

All escapes of a chain of contexts are known beforehand, so a position costs one of three forms: the entry in the longest context;
or an entry further up plus sums stored with two contexts of the chain; or the uniform rest. Equal positions of a block are scored
once.

Baseline. Words need counts over the corpus, whose vocabulary has no bound and is never broadcast: each block reports the 64-bit hashes of
its distinct words (the end is the empty word) with their counts, dealt into parts by hash; a task adds up a part and sends every block the
counts of its words. Words are told apart by their hashes alone.

Frames that are not a plain scan of Parquet files, in which rows have no lasting place, are written to the shared folder first.

Training uses rows whose crc32(id as text) mod 5 is not `held_out`; rows with a null id are scored, not learned from, and not held
out. A null text is empty: one end token. Texts of any length are scored whole, with some 60 bytes of
memory for each of their bytes. Repeated rows count each, equal texts score
equally. Without training rows the base score is 0 per token and the model uniform. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, chunks, id_bucket, mix64, small_batches, text_bytes, word_hashes, word_spans

ORDER = 5
#: Parts of the trie, by the last two bytes of contexts, and of the words; keys of one part of one block that are one row.
SUFFIXES, BLOB = 256, 4096
#: Text of a block of documents, on average over the table.
BLOCK_BYTES = 1 << 26
PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never has
_LOG = np.log10


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each position of texts and their ends: ORDER bytes before and the symbol; and n + 1 offsets into them."""
    n, lead = len(offsets) - 1, 8 - 1  # every number is read as the eight bytes that end at its symbol
    shifted = offsets + np.arange(n + 1) * (lead + 1)
    full = np.full(int(shifted[-1]), PAD, np.uint8)
    text = np.ones(len(full), bool)
    edges = (shifted[:-1, None] + np.arange(lead)).ravel()
    text[edges] = False
    ends = shifted[1:] - 1
    text[ends] = False
    full[text] = LOWER[data]
    full[ends] = END
    text[ends] = True
    windows = np.ndarray((max(0, len(full) - lead),), ">u8", full.tobytes(), strides=(1,))
    return windows[text[lead:]].astype(np.int64) & ((1 << (8 * (ORDER + 1))) - 1), offsets + np.arange(n + 1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their added counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    code, distinct = pd.factorize(keys)
    return distinct, np.bincount(code, weights=counts, minlength=len(distinct)).astype(np.int64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of texts, in lower case, and n + 1 offsets into them; the end of a text, hash 0, is not among them."""
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets)
    return (word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)).view(np.int64), before


def _distinct(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, distinct = pd.factorize(key)
    return distinct, np.bincount(code, weights=train, minlength=len(distinct)).astype(np.int64)


def _reported(rows: DataFrame) -> DataFrame:
    """(kind, block, part, key, n): the distinct grams (kind 0) and words (kind 1) of each block by parts, n as often as training texts have them, as bytes of int64.

    A block of very many, or one that a split cuts, may report a key more than once.
    """

    def packed(kind: int, block: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        suffix = (keys if kind else keys >> 8 & 0xFFFF).astype(np.uint64)
        part = (mix64(suffix) % np.uint64(SUFFIXES)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, keys, n = part[order], keys[order], n[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
        cuts = [(x, min(x + BLOB, b)) for a, b in zip(edges[:-1], edges[1:], strict=True) for x in range(a, b, BLOB)]
        columns = [pa.array([kind] * len(cuts), pa.int32()), pa.array([block] * len(cuts), pa.int64()), pa.array([int(part[a]) for a, _ in cuts], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (keys, n)]], ["kind", "block", "part", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, ([], []), [0, 0]

        def close() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if parts[kind]:
                    yield from packed(kind, block, *_merged(parts[kind]))

        for batch in batches:
            blocks, train = batch["block"].to_numpy(), np.array(batch["train"].to_pylist(), float)
            data, offsets = text_bytes(batch["text"])
            edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(batch)]]).tolist()
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                if first == last:
                    continue
                if blocks[first] != block:
                    yield from close()
                    block, parts, held = int(blocks[first]), ([], []), [0, 0]
                inner = offsets[first : last + 1]
                for lo, hi in chunks(inner):
                    own, weight = (data[inner[lo] : inner[hi]], inner[lo : hi + 1] - inner[lo]), train[first + lo : first + hi]
                    gram, at = grams(*own)
                    word, before = words(*own)
                    parts[0].append(_distinct(gram, np.repeat(weight, np.diff(at))))
                    parts[1].append(_distinct(np.append(word, 0), np.append(np.repeat(weight, np.diff(before)), weight.sum())))
                    for kind in (0, 1):
                        held[kind] += len(parts[kind][-1][0])
                        if held[kind] > 1_500_000:
                            parts[kind][:] = [_merged(parts[kind])]
                            held[kind] = len(parts[kind][0][0])
                            if held[kind] > 900_000:
                                yield from packed(kind, block, *parts[kind][0])
                                parts[kind].clear()
                                held[kind] = 0
        yield from close()

    return rows.select("block", "text", "train").mapInArrow(run, "kind int, block long, part int, key binary, n binary")


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(batch[c].to_pylist()), np.int64) for c in ("key", "n"))


def _low_counts(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (last byte of the context, symbol) keys, 65,536 at most, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            gram, count = _pairs(batch)
            n += np.bincount(gram & 0xFFFF, weights=count, minlength=1 << 16).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["key", "n"])

    rows = found.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return tuple(np.array(sorted((r.key, r.n) for r in rows), np.int64).reshape(-1, 2).T)


class Model:
    """Per order k: contexts (sorted) with total, number of kept symbols and sums over escapes; entries (sorted) with counts."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]):
        """entries[k]: sorted (context, symbol) keys and counts; totals[k]: sorted contexts and how often they came up, pruned symbols included."""
        self.keys = [k for k, _ in entries]
        self.log_count = [_LOG(np.maximum(c, 1)) for _, c in entries]
        self.contexts = [k for k, _ in totals]
        self.rest = -_LOG(256.0)
        self.first, self.leave, self.stop, self.full = [], [], [], []
        above = None  # per context of the order before: sum of escapes from there on, pruned mass, symbols, total
        for k, ((key, count), (context, total)) in enumerate(zip(entries, totals, strict=True)):
            owner = np.searchsorted(context, key >> 8)
            kinds, kept = np.bincount(owner, minlength=len(context)).astype(float), np.bincount(owner, weights=count, minlength=len(context))
            pruned = total - kept
            first = _LOG(total + kinds)  # denominator where coding begins
            escape = _LOG(np.maximum(pruned + kinds, 1e-300)) - first
            if k == 0:
                self.uniform = -_LOG(np.maximum(256 - kinds, 1))  # what no context has shown
                chain, leave, stop = np.zeros(len(context)), escape, np.zeros(len(context))
            else:
                suffix = np.searchsorted(self.contexts[k - 1], context & ((1 << (8 * (k - 1))) - 1) if k > 1 else np.zeros(len(context), np.int64))
                shorter = np.searchsorted(entries[k - 1][0], key & ((1 << (8 * k)) - 1))
                seen = np.bincount(owner, weights=entries[k - 1][1][shorter], minlength=len(context))
                up_total, up_kinds, up_pruned, up_chain = (a[suffix] for a in above)
                space = up_total - seen + up_kinds - kinds  # the next shorter context without the symbols excluded
                away = up_pruned + up_kinds - kinds
                step = np.where(away > 0, _LOG(np.maximum(away, 1e-300)) - _LOG(np.maximum(space, 1e-300)), 0.0)
                chain = up_chain + step  # escapes of all shorter contexts
                leave = escape + chain
                stop = -chain - _LOG(np.maximum(space, 1e-300))  # ends at the next shorter context with an entry there
            self.first.append(first)
            self.leave.append(leave)
            self.stop.append(stop)
            above = (total.astype(float), kinds, pruned, chain)

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each distinct gram's symbol after its context."""
        out = np.full(len(gram), self.rest)
        deepest, place = np.full(len(gram), -1), np.zeros(len(gram), np.int64)
        todo = np.arange(len(gram))
        for k in range(ORDER, -1, -1):  # the longest context that is known
            at, known = self._find(self.contexts[k], self._context(gram[todo], k))
            deepest[todo[known]], place[todo[known]] = k, at[known]
            todo = todo[~known]
        todo = np.flatnonzero(deepest >= 0)
        for k in range(ORDER, -1, -1):  # the longest context that has shown the symbol
            who = todo[deepest[todo] >= k]
            at, shown = self._find(self.keys[k], gram[who] & ((1 << (8 * (k + 1))) - 1))
            who, at = who[shown], at[shown]
            here = deepest[who] == k
            out[who[here]] = self.log_count[k][at[here]] - self.first[k][place[who[here]]]
            up, at = who[~here], at[~here]
            if len(up):
                below = np.searchsorted(self.contexts[k + 1], self._context(gram[up], k + 1))
                out[up] = self._leave(deepest[up], place[up]) + self.stop[k + 1][below] + self.log_count[k][at]
            done = np.zeros(len(gram), bool)
            done[who] = True
            todo = todo[~done[todo]]
        if len(todo):
            out[todo] = self._leave(deepest[todo], place[todo]) + self.uniform[0]
        return out

    @staticmethod
    def _context(gram: np.ndarray, k: int) -> np.ndarray:
        return (gram >> 8) & ((1 << (8 * k)) - 1)

    @staticmethod
    def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return at, table[at] == key

    def _leave(self, order: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(order))
        for k in np.unique(order).tolist():
            at = order == k
            out[at] = self.leave[k][place[at]]
        return out


def _part_model(gram: np.ndarray, count: np.ndarray, low: tuple[np.ndarray, np.ndarray], max_entries: int | None) -> Model:
    """The model of a part's contexts from its training grams and the counts of order 1 of all parts."""
    symbols, entries, totals = int(low[1].sum()), [], []
    for k in range(ORDER + 1):
        key, n = _sums(*(low if k < 2 else (gram, count)), (1 << (8 * (k + 1))) - 1, 0)
        kept = n * max_entries >= symbols if max_entries else np.ones(len(key), bool)
        context, total = _sums(key, n, -1, 8)
        some = np.isin(context, key[kept] >> 8)
        entries.append((key[kept], n[kept]))
        totals.append((context[some], total[some]))
    return Model(entries, totals)


def _sums(key: np.ndarray, n: np.ndarray, mask: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys after mask and shift, and their added counts."""
    distinct, code = np.unique((key & mask) >> shift, return_inverse=True)
    return distinct, np.bincount(code, weights=n, minlength=len(distinct)).astype(np.int64)


def _answers(found: DataFrame, low: tuple[np.ndarray, np.ndarray], max_entries: int | None) -> DataFrame:
    """(block, key, worth): log10 probabilities of the grams of _reported(), as bytes of float64."""
    shared = found.sparkSession.sparkContext.broadcast(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts, held, model = None, [], 0, None
        for batch in batches:
            at, asked = batch["part"].to_numpy(), batch["asked"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (np.diff(asked) != 0)) + 1, [len(batch)]]).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if at[a] != part:
                    part, parts, held, model = at[a], [], 0, None
                some = batch.slice(a, b - a)
                if not asked[a]:  # the counts of a part come before its questions
                    gram, n = _pairs(some)
                    parts.append((gram[n > 0], n[n > 0]))
                    held += len(parts[-1][0])
                    if held > 2_000_000 and held > 2 * len(parts[0][0]):
                        parts = [_merged(parts)]
                        held = len(parts[0][0])
                    continue
                if model is None:
                    model, parts = _part_model(*_merged(parts), shared.value, max_entries), []
                texts = some["key"].to_pylist()
                worth = model.log10(np.frombuffer(b"".join(texts), np.int64))
                ends = np.cumsum([0] + [len(t) // 8 for t in texts]).tolist()
                answers = pa.array([worth[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([some["block"], some["key"], answers], ["block", "key", "worth"])

    return _counts_and_questions(found).mapInArrow(run, "block long, key binary, worth binary")


def _counts_and_questions(found: DataFrame) -> DataFrame:
    """Every row twice, by part: as a count, and after these as a question of its block."""
    counts = found.withColumn("asked", F.lit(0)).select("part", "asked", "block", "key", "n")
    questions = found.select("part", F.lit(1).alias("asked"), "block", "key", F.lit(None).cast("binary").alias("n"))
    return counts.union(questions).repartition("part").sortWithinPartitions("part", "asked")


def _word_counts(found: DataFrame) -> DataFrame:
    """(block, key, worth, tokens, vocabulary): the counts of the words of _reported() as bytes of int64; a row without block per part has its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts, held, known = None, [], 0, None
        names = ["block", "key", "worth", "tokens", "vocabulary"]
        for batch in batches:
            at, asked = batch["part"].to_numpy(), batch["asked"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (np.diff(asked) != 0)) + 1, [len(batch)]]).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if at[a] != part:
                    part, parts, held, known = at[a], [], 0, None
                some = batch.slice(a, b - a)
                if not asked[a]:
                    parts.append(_pairs(some))
                    held += len(parts[-1][0])
                    if held > 2_000_000 and held > 2 * len(parts[0][0]):
                        parts = [_merged(parts)]
                        held = len(parts[0][0])
                    continue
                if known is None:
                    keys, n = _merged(parts)
                    order, parts = np.argsort(keys), []
                    known = keys[order], n[order]
                    sums = [pa.array([int(n.sum())], pa.int64()), pa.array([int((n > 0).sum())], pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *sums], names)
                texts = some["key"].to_pylist()
                counts = known[1][np.searchsorted(known[0], np.frombuffer(b"".join(texts), np.int64))]
                ends = np.cumsum([0] + [len(t) // 8 for t in texts]).tolist()
                answers = pa.array([counts[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([some["block"], some["key"], answers, pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], names)

    return _counts_and_questions(found).mapInArrow(run, "block long, key binary, worth binary, tokens long, vocabulary long")


def _in_files(docs: DataFrame) -> bool:
    """Whether rows have a lasting place: a scan of Parquet files with nothing but projections and filters."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return "FileScan parquet" in plan and not re.search("Exchange|Join|Aggregate|Limit|Sample|InMemoryTable|Window|Union|Coalesce", plan)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with `block`: neighbours in a file, BLOCK_BYTES of text on average."""
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    height = max(1, BLOCK_BYTES * size.n // max(1, size.bytes or 0)) if size.n else 1
    return rows.withColumn("block", F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / F.lit(height))))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, max_entries: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark, 400)
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not _in_files(rows):
        rows = scratch.write(rows)
    rows = _in_blocks(rows).withColumn("rest", id_bucket(F.col("doc_id"))).withColumn("train", F.coalesce(F.col("rest") != held_out, F.lit(False)))
    rows = rows.withColumn("held_out", F.coalesce(F.col("rest") == held_out, F.lit(False))).drop("rest")
    found = scratch.write(_reported(rows), "kind")
    of_grams = found.where("kind = 0")
    answers = _answers(of_grams, _low_counts(of_grams), max_entries)
    counts = scratch.write(_word_counts(found.where("kind = 1")))
    known = counts.where("block IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("v")).first()
    tokens, scale = int(known.n), known.n + 0.5 * (known.v + 1)

    def table(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, worth = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        parts.clear()
        return keys[order], worth[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, tables = None, ([], []), None
        for batch in batches:
            blocks, kind = batch["block"].to_numpy(), batch["kind"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kind) != 0)) + 1, [len(batch)]]).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, parts, tables = blocks[a], ([], []), None
                part = batch.slice(a, b - a)
                if kind[a] < 2:  # the grams and words of a block come before its documents
                    parts[kind[a]].append(tuple(np.frombuffer(b"".join(part[c].to_pylist()), t) for c, t in (("key", np.int64), ("worth", (np.float64, np.int64)[kind[a]]))))
                    continue
                if tables is None:
                    tables = [table(p) for p in parts]
                data, offsets = text_bytes(part["text"])
                base, sizes, known_here, scores = ([np.zeros(0)] for _ in range(4))
                for lo, hi in chunks(offsets):
                    own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                    gram, at = grams(*own)
                    code, distinct = pd.factorize(gram)
                    scores.append(np.add.reduceat(tables[0][1][np.searchsorted(tables[0][0], distinct)][code], at[:-1]))
                    word, before = words(*own)
                    code, distinct = pd.factorize(np.append(word, 0))
                    c = tables[1][1][np.searchsorted(tables[1][0], distinct)]
                    value, seen = _LOG((c + 0.5) / scale)[code], (c > 0)[code]
                    owner = np.repeat(np.arange(hi - lo), np.diff(before))
                    base.append(np.bincount(owner, weights=value[:-1], minlength=hi - lo) + value[-1])
                    known_here.append(np.bincount(owner, weights=seen[:-1], minlength=hi - lo) + seen[-1])
                    sizes.append(np.diff(before) + 1)
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, known_here)] + [pa.array([tokens] * len(part), pa.int64())]
                columns += [pa.array(np.concatenate(x)) for x in (base, scores)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], *columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    empty = {"key": "binary", "worth": "binary", "doc_id": "long", "held_out": "boolean", "text": "string"}
    order = ["block", "kind", *empty]
    add = lambda df, kind: df.withColumn("kind", F.lit(kind)).withColumns({c: F.lit(None).cast(t) for c, t in empty.items() if c not in df.columns}).select(order)
    both = add(answers, 0).union(add(counts.where("block IS NOT NULL"), 1)).union(add(rows.drop("train"), 2)).repartition("block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
