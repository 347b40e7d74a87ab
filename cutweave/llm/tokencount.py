"""Token counts: greedy longest-match word pieces counted by a linear automaton, without building the pieces.

The vocabulary trie gets failure links: link(v) is the node of what is left of v's string once the greedy tokens that can no
longer grow are popped, and popped(v) is their number, computed beforehand. A word is read byte by byte; where the trie has no
edge, the automaton adds popped(v) and follows the link, so a word of n bytes takes O(n) steps. The words of a batch advance together; the last
few, if they are very long, go on one by one.

Words are runs of anything but ASCII white space; each is read with the white-space marker before it. A word with a character
that the vocabulary lacks is one unknown token, as word-piece tokenizers have it. Words may be of any length.
A null or empty text has no tokens. Repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, text_bytes, word_spans
from .vocab import DEFAULT_MODEL, DoubleArray, load_pieces


#: Words that go on together as long as more than FEW of them last; beyond LONG bytes fewer go on one by one.
FEW, LONG = 16, 128


class Counter:
    def __init__(self, trie: DoubleArray):
        self.base, self.check, self.lists = trie.base, trie.check, None
        n = len(trie.base)
        self.link, self.popped = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        for v in trie.order[1:]:
            parent = int(trie.check[v])
            if trie.value[v] >= 0:
                self.link[v], self.popped[v] = 0, 1
                continue
            z, pops, c = int(self.link[parent]), int(self.popped[parent]), v - int(trie.base[parent])
            while z >= 0 and (to := trie.step(z, c)) < 0:
                pops += int(self.popped[z])
                z = int(self.link[z])
            if z >= 0:
                self.link[v], self.popped[v] = to, pops

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, marker: bytes = b" ") -> np.ndarray:
        """Tokens of each word with the marker before it; -1: unknown."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: the words that still go on are the first ones
        begin, length = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        lasting = len(order)
        for i in range(-len(marker), int(length[0]) if len(order) else 0):
            lasting = int(np.searchsorted(-length[:lasting], -i, "left")) if i >= 0 else lasting
            if i >= LONG and lasting <= FEW:
                for k in range(lasting):
                    state[k], total[k] = self._alone(int(state[k]), int(total[k]), data[begin[k] + i : begin[k] + length[k]].tobytes())
                break
            c = data[begin[:lasting] + i].astype(np.int32) if i >= 0 else np.full(lasting, marker[i], np.int32)
            self._advance(state, total, c)
        self._finish(state, total)
        out = np.empty(len(order), np.int64)
        out[order] = np.where(state < 0, -1, total)
        return out

    def _advance(self, state: np.ndarray, total: np.ndarray, c: np.ndarray) -> None:
        """One byte for the first len(c) words; a state of -1 is an unknown word."""
        todo = np.flatnonzero(state[: len(c)] >= 0)
        while len(todo):
            v = state[todo]
            to = self.base[v] + c[todo]
            fits = self.check[to] == v
            state[todo[fits]] = to[fits]
            todo, v = todo[~fits], v[~fits]
            total[todo] += self.popped[v]
            state[todo] = self.link[v]
            todo = todo[state[todo] >= 0]

    def _alone(self, state: int, total: int, text: bytes) -> tuple[int, int]:
        """Reads the rest of one word; a state of -1 is an unknown word."""
        if self.lists is None:
            self.lists = [a.tolist() for a in (self.base, self.check, self.link, self.popped)]
        base, check, link, popped = self.lists
        for c in text:
            while state >= 0 and check[base[state] + c] != state:
                total += popped[state]
                state = link[state]
            if state < 0:
                break
            state = base[state] + c
        return state, total

    def _finish(self, state: np.ndarray, total: np.ndarray) -> None:
        todo = np.flatnonzero(state > 0)
        while len(todo):
            v = state[todo]
            total[todo] += self.popped[v]
            state[todo] = self.link[v]
            todo = todo[state[todo] > 0]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """id, n_words, n_tokens (an unknown word counts as one), n_unknown."""
    spark = docs.sparkSession
    small_batches(spark)
    counter = spark.sparkContext.broadcast(Counter(load_pieces(model).trie()))  # as large as the vocabulary
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["_text"])
            sums = [np.zeros((3, 0), np.int64)]
            for lo, hi in chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, before = word_spans(part, at)
                n = counter.value.counts(part, starts, ends)
                running = [np.concatenate([[0], np.cumsum(x)]) for x in (np.abs(n), n < 0)]
                sums.append(np.stack([np.diff(before), *[np.diff(r[before]) for r in running]]))
            columns = np.concatenate(sums, 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["_id"], *[pa.array(x) for x in columns]], ["_id", "n_words", "n_tokens", "n_unknown"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("_id", id_col)
