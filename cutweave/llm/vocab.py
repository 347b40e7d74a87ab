"""Piece vocabularies as double-array tries over bytes."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: The vocabulary file that the registered queries use; a parameter of every operator.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class DoubleArray:
    """base, check: node v has a child for byte c at base[v] + c if check[base[v] + c] == v. value: the key's number or -1. Node 0 is the root."""

    def __init__(self, keys: Iterable[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, number in keys:
            v = 0
            for c in key:
                if c not in children[v]:
                    children[v][c] = len(children)
                    children.append({})
                    value.append(-1)
                v = children[v][c]
            value[v] = number
        size = 4 * len(children) + 65536
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        values = np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0], window = False, 4096
        front, wide = 1, 1  # where the search for places begins, for single children and for families
        self.order: list[int] = [0]  # slots, parents before children
        at, todo = {0: 0}, [0]
        for v in todo:
            kids = sorted(children[v])
            if not kids:
                continue
            slot = max(front if len(kids) == 1 else wide, kids[0] + 1)
            while True:  # the first free slot for the smallest byte at which all others fit
                if slot + window + 256 > len(free):
                    base, check, values = (np.concatenate([a, np.full(size, x, np.int32)]) for a, x in ((base, 0), (check, -1), (values, -1)))
                    free = np.concatenate([free, np.ones(size, bool)])
                fits = free[slot : slot + window].copy()
                for c in kids[1:]:
                    fits &= free[slot + c - kids[0] : slot + c - kids[0] + window]
                if fits.any():
                    break
                slot += window
                if len(kids) > 1:
                    wide = slot
            slot += int(fits.argmax())
            if len(kids) == 1:
                front = max(front, slot - 256)
            b = slot - kids[0]
            base[at[v]] = b
            for c in kids:
                free[b + c] = False
                check[b + c] = at[v]
                values[b + c] = value[children[v][c]]
                at[children[v][c]] = b + c
                self.order.append(b + c)
                todo.append(children[v][c])
        used = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
        self.base, self.check, self.value = (np.ascontiguousarray(np.concatenate([a, np.full(257, x, np.int32)])[:used]) for a, x in ((base, 0), (check, -1), (values, -1)))

    def step(self, v: int, c: int) -> int:
        t = int(self.base[v]) + c
        return t if self.check[t] == v else -1


@dataclass
class Pieces:
    """Pieces as bytes (the white-space marker as a blank), log scores, what is matched, and the ids of single bytes."""

    text: list[bytes]
    score: np.ndarray
    normal: np.ndarray
    byte_id: np.ndarray  # -1 without byte fallback
    unk: int
    control: np.ndarray
    dummy_prefix: bool

    def trie(self) -> DoubleArray:
        return DoubleArray((self.text[i], int(i)) for i in np.flatnonzero(self.normal))


@lru_cache(maxsize=4)
def load_pieces(path: str = DEFAULT_MODEL, scores: str = "auto") -> Pieces:
    """Reads a SentencePiece model file.

    scores: "file" takes its scores for log probabilities; "zipf" gives the piece of rank r the log probability of rank r under a
    Zipf-Mandelbrot law, for files whose scores are merge ranks; "auto" takes "file" for Unigram models and "zipf" for others.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    assert sentencepiece.__version__
    n = len(model.pieces)
    kind = np.array([p.type for p in model.pieces])
    normal = np.isin(kind, [kinds.NORMAL, kinds.USER_DEFINED])
    score = np.array([p.score for p in model.pieces], float)
    unigram = model.trainer_spec.model_type == 1
    if scores == "zipf" or scores == "auto" and not unigram:
        rank = np.full(n, n, float)
        rank[np.flatnonzero(normal)[np.argsort(-score[normal], kind="stable")]] = np.arange(normal.sum())
        score = -np.log(rank + 2.7)
        score -= math.log(np.exp(score[normal]).sum())
    byte_id = np.full(256, -1, np.int32)
    text = []
    for i, p in enumerate(model.pieces):
        if p.type == kinds.BYTE:
            code = int(p.piece[1:-1], 16)
            byte_id[code] = i
            text.append(bytes([code]))
        else:
            text.append(p.piece.replace("▁", " ").encode() if normal[i] else b"")
    return Pieces(text, score, normal, byte_id, int(np.flatnonzero(kind == kinds.UNKNOWN)[0]), kind == kinds.CONTROL, model.normalizer_spec.add_dummy_prefix)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every span, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
