"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

Encoding puts a blank before the text (if the model says so), reads blanks as the white-space marker and finds the piece sequence with the
largest sum of log scores. A character without a piece scores UNKNOWN_GAP below the least likely piece and becomes its
UTF-8 byte pieces (the unknown piece, if the model has none). Ties: the path whose last piece is longer.

No piece holds a marker after another character, so a segmentation always breaks there, and before and after line breaks and tabs, which
occur in byte pieces only (both are verified when the model is loaded). Texts are therefore cut into words there, every distinct word
of a chunk of texts is segmented once, all of them advancing together, and the results are put back by position.
Words longer than LONG bytes are segmented one by one, in time linear in their length.

Decoding concatenates pieces and bytes, turns markers into blanks, drops the first blank, and replaces each byte that is not part of
valid UTF-8. It gives the text back exactly, but that U+2581, the marker itself, comes back as a blank.

A null text gives null ids, an empty text no ids; null ids decode to null; an empty table gives an empty result. Special pieces are never matched in texts and decode to
nothing. Repeated rows are encoded each. Other columns come along only in `carry`, as a struct that cannot clash.
"""

from __future__ import annotations

import codecs
import math
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, small_batches, table, text_bytes, word_hashes
from .vocab import DEFAULT_MODEL, Pieces, load_pieces, ragged

UNKNOWN_GAP = 10.0
LONG = 256
MARKER = "▁".encode()


codecs.register_error("replace-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Segmenter:
    def __init__(self, pieces: Pieces):
        self.pieces, trie = pieces, pieces.trie()
        self.base, self.check, self.value = trie.base, trie.check, trie.value
        self.score = np.append(pieces.score, pieces.score[pieces.normal].min() - UNKNOWN_GAP)
        self.unknown = len(pieces.score)  # stands for "character without a piece"
        used = [pieces.text[i] for i in np.flatnonzero(pieces.normal)]
        self.cuts_at_blanks = not any(t.lstrip(b" ").find(b" ") >= 0 for t in used)
        self.breaks = np.zeros(256, bool)
        for c in b"\n\r\t":
            self.breaks[c] = not any(c in t for t in used)
        self.longest, self.lists = max(map(len, used)), None

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words of texts, and the number of words before each text."""
        start = np.zeros(len(data) + 1, bool)
        start[offsets] = True
        if len(data):
            if self.cuts_at_blanks:
                blank = data == 32
                start[1:-1] |= blank[1:] & ~blank[:-1]
            alone = self.breaks[data]
            start[:-1] |= alone
            start[1:] |= alone
        starts = np.flatnonzero(start[:-1])
        return starts, np.searchsorted(starts, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of texts that lie behind one another, n + 1 offsets into them, the sum of scores of each text."""
        if self.pieces.dummy_prefix:
            full = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        starts, before = self.spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.zeros(len(offsets) - 1)
        ends = np.append(starts[1:], len(data))
        code, distinct = pd.factorize(word_hashes(data, starts, ends))
        first = np.full(len(distinct), -1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        ids, at, score = self.words(data, starts[first], ends[first])
        length = np.diff(at)[code]
        out = ids[ragged(at[:-1][code], length)]
        lengths, scores = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0.0], np.cumsum(score[code])])
        return out, lengths[before], np.diff(scores[before])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of words, n + 1 offsets into them, scores."""
        size = ends - starts
        short = np.flatnonzero(size <= LONG)
        owner, place, piece, width, score = self._together(data, starts[short], size[short])
        found, scores = [(short[owner], place, piece, width)], np.zeros(len(starts))
        scores[short] = score
        for i in np.flatnonzero(size > LONG):
            p, c, w, scores[i] = self._alone(data[starts[i] : ends[i]].tobytes())
            found.append((np.full(len(p), i), p, c, w))
        owner, place, piece, width = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        order = np.lexsort((place, owner))
        owner, place, piece, width = owner[order], place[order], piece[order], width[order]
        # characters without a piece become bytes
        bytewise = (piece == self.unknown) & (self.pieces.byte_id.min() >= 0)
        times = np.where(bytewise, width, 1)
        ids = np.where(piece == self.unknown, self.pieces.unk, piece)[np.repeat(np.arange(len(piece)), times)]
        if bytewise.any():
            where = np.repeat(bytewise, times)
            ids[where] = self.pieces.byte_id[data[ragged(starts[owner[bytewise]] + place[bytewise], width[bytewise])]]
        n = np.bincount(owner, weights=times, minlength=len(starts)).astype(np.int64)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(n)]), scores

    def _together(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray):
        """Viterbi for many words at once: all matches first, then by place in the word and length."""
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0)
        word = np.repeat(np.arange(len(starts), dtype=np.int32), size)
        place = ragged(np.zeros(len(starts), np.int64), size).astype(np.int32)
        where = starts[word] + place
        lead = data[where]
        head = (lead & 0xC0) != 0x80
        word, place, where, lead = word[head], place[head], where[head], lead[head]
        width = np.ones(len(lead), np.int32) + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        width = np.minimum(width, size[word] - place).astype(np.int32)
        covered = np.zeros(len(word), bool)
        live, state, matches = np.arange(len(word), dtype=np.int32), np.zeros(len(word), np.int32), []
        for depth in range(self.longest):
            live_in = place[live] + depth < size[word[live]]
            live, state = live[live_in], state[live_in]
            if not len(live):
                break
            to = self.base[state] + data[where[live] + depth]
            fits = self.check[to] == state
            live, state = live[fits], to[fits]
            hit = self.value[state] >= 0
            if hit.any():
                who = live[hit]
                matches.append((who, np.full(len(who), depth + 1, np.int32), self.value[state[hit]]))
                covered[who[width[who] == depth + 1]] = True
        bare = np.flatnonzero(~covered).astype(np.int32)
        matches.append((bare, width[bare], np.full(len(bare), self.unknown, np.int32)))
        who, length, piece = (np.concatenate(x) for x in zip(*matches, strict=True))
        del matches, live, state
        node = np.concatenate([[0], np.cumsum(size + 1)])  # a node before each byte and one at the end of a word
        key = place[who] * (self.longest + 1) + length
        order = np.argsort(key, kind="stable")
        who, length, piece, key = who[order], length[order], piece[order], key[order]
        begin = node[word[who]] + place[who]
        end, gain = begin + length, self.score[piece]
        best = np.full(node[-1], -np.inf)
        best[node[:-1]] = 0
        back_len, back_piece = np.zeros(node[-1], np.int32), np.zeros(node[-1], np.int32)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):  # within one place and length every end occurs once
            e = end[a:b]
            total = best[begin[a:b]] + gain[a:b]
            up = total > best[e]
            e = e[up]
            best[e], back_len[e], back_piece[e] = total[up], length[a:b][up], piece[a:b][up]
        owner, at, out = np.arange(len(starts)), node[:-1] + size, []
        while len(owner):
            w, p = back_len[at], back_piece[at]
            at = at - w
            out.append((owner, at - node[owner], p, w))
            more = at > node[owner]
            owner, at = owner[more], at[more]
        return (*(np.concatenate(x) for x in zip(*out, strict=True)), best[node[:-1] + size])

    def _alone(self, text: bytes):
        if self.lists is None:
            self.lists = [a.tolist() for a in (self.base, self.check, self.value, self.score)]
        base, check, value, score = self.lists
        n, lost = len(text), score[self.unknown]
        best, width, piece = array("d", [-math.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            so_far = best[i]
            if so_far == -math.inf:
                continue
            lead = text[i]
            size = min(1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), n - i)
            v, j, covered = 0, i, False
            while j < n:
                to = base[v] + text[j]
                if check[to] != v:
                    break
                v, j = to, j + 1
                p = value[v]
                if p >= 0:
                    covered |= j - i == size
                    total = so_far + score[p]
                    if total > best[j]:
                        best[j], width[j], piece[j] = total, j - i, p
            if not covered and so_far + lost > best[i + size]:
                best[i + size], width[i + size], piece[i + size] = so_far + lost, size, self.unknown
        ends, at = [], n
        while at:
            ends.append(at)
            at -= width[at]
        ends = np.array(ends[::-1], np.int64)
        size = np.frombuffer(width, np.int32)[ends].astype(np.int64)
        return ends - size, np.frombuffer(piece, np.int32)[ends].astype(np.int64), size, best[n]


class Joiner:
    """Decodes ids by gathering the bytes of their pieces."""

    def __init__(self, pieces: Pieces):
        self.size = np.array([len(t) for t in pieces.text])
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(pieces.text), np.uint8)
        self.dummy_prefix = pieces.dummy_prefix

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        out: list[str] = []
        for lo, hi in chunks(offsets, 1 << 18):
            out += self._decode(ids[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        return out

    def _decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        size = self.size[ids]
        data = self.data[ragged(self.start[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            a += self.dummy_prefix and data[a : a + 1] == b" " and a < b
            out.append(data[a:b].decode("utf-8", "replace-each-byte"))
        return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, scores: str = "auto", carry: Sequence[str] = ()) -> DataFrame:
    """id, ids array<int>, log_score, and `carry` as a struct `kept`."""
    spark = docs.sparkSession
    small_batches(spark, 400)
    shared = spark.sparkContext.broadcast(Segmenter(load_pieces(model, scores)))  # as large as the vocabulary
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([F.struct(*[F.col(c) for c in carry]).alias("kept")] if carry else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["_text"]
            data, offsets = text_bytes(texts)
            if MARKER in data.tobytes():
                data, offsets = text_bytes(pa.array([t.replace("▁", " ") if t else t for t in texts.to_pylist()], pa.string()))
            ids, ends, scores_ = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0)]
            for lo, hi in chunks(offsets):
                i, at, s = shared.value.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids.append(i)
                ends.append(at[1:] + ends[-1][-1])
                scores_.append(s)
            null = texts.is_null() if texts.null_count else None
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(ids)), mask=null)
            yield pa.RecordBatch.from_arrays([batch["_id"], lists, pa.array(np.concatenate(scores_)), *([batch["kept"]] if carry else [])], out.names)

    kept = [rows.schema["kept"]] if carry else []
    out = T.StructType([rows.schema["_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_score", T.DoubleType()), *kept])
    return rows.mapInArrow(run, out).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = DEFAULT_MODEL, carry: Sequence[str] = ()) -> DataFrame:
    """decoded (string), and `carry` as a struct `kept`."""
    spark = encoded.sparkSession
    small_batches(spark, 400)
    shared = spark.sparkContext.broadcast(Joiner(load_pieces(model)))
    rows = encoded.select(F.col(ids_col).cast("array<int>").alias("_ids"), *([F.struct(*[F.col(c) for c in carry]).alias("kept")] if carry else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["_ids"]
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = shared.value.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets)
            if lists.null_count:
                texts = [None if x else t for x, t in zip(lists.is_null().to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *([batch["kept"]] if carry else [])], out.names)

    out = T.StructType([T.StructField("decoded", T.StringType()), *([rows.schema["kept"]] if carry else [])])
    return rows.mapInArrow(run, out)


def round_trip(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """Per document: its ids, their number and score, the SHA-1 of the text decoded from them, and whether that is the text."""
    rows = docs.select("doc_id", "text", F.sha1(F.translate("text", "▁", " ").cast("binary")).alias("sha1"))
    coded = encode(rows, model=model, carry=["sha1"])
    back = decode(coded, model=model, carry=["doc_id", "ids", "log_score", "kept"])
    decoded = F.sha1(F.col("decoded").cast("binary"))
    return back.select(
        F.col("kept.doc_id").alias("doc_id"),
        F.col("kept.ids").alias("ids"),
        F.coalesce(F.size("kept.ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.col("kept.log_score").alias("log_score"),
        decoded.alias("decoded_sha1"),
        decoded.eqNullSafe(F.col("kept.kept.sha1")).alias("round_trip"),
    )


def round_trip_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
