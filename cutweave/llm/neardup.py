"""MinHash near-duplicates with odd sketches.

1. One pass over the texts gives each document's set of distinct five-word shingles as hashes, its size and a 128-bit digest, MinHash
   samples, band keys made of them, and the odd sketch: the samples folded into a parity bitmap.
2. Documents with equal sets become one class, however many they are; the smallest id stands for it.
3. Documents that share a band key lie in one cluster (components of the graph "document - smallest document of its bucket"), so
   no bucket is ever expanded into pairs. Every linked pair that shares a band is inside one cluster.
4. Inside clusters pairs are compared in blocks of about BLOCK documents or BLOCK_SHINGLES shingles at most: XOR of two odd sketches, population count against a
   limit that a linked pair exceeds with a probability of less than one in a million, then the exact test on the full shingle sets.
   Pairs already connected are skipped. First each block is compared with itself and with the cluster's smallest document; only
   clusters that this leaves in several parts are then compared block against block.
5. Components of the confirmed links.

With BANDS x ROWS samples a pair with similarity s shares no band with probability (1 - s^ROWS)^BANDS: 5e-7 at 0.8, 1e-10 at 0.85.

Words are runs of anything but ASCII white space, A-Z in lower case. A text with one to four words has its whole sequence as the
only shingle; a text without words (or null) has none and is linked with nothing. Rows with a null id link with nothing and keep a
null component. Ties: a similarity equal to the bound links. Repeated rows share a component. Texts of any length are taken whole (a single one in
one step, with some 60 bytes of memory for each of its bytes). An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import LOWER, Scratch, chunks, mix64, small_batches, splitmix, text_bytes, word_hashes, word_spans
from .vocab import ragged

SHINGLE, BANDS, ROWS, BITS = 5, 48, 6, 1024
#: Documents, and shingles, of a block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles that are looked up at once.
GATHER = 1 << 19
#: Candidates (16 bytes each) that may be broadcast to pick texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_STEP = splitmix(SHINGLE, 11) | np.uint64(1)
_SAMPLES = BANDS * ROWS
_MUL = (splitmix(_SAMPLES, 13) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (splitmix(_SAMPLES, 17) >> np.uint64(32)).astype(np.uint32)
_SALT = splitmix(_SAMPLES, 19)


def sketch_limit(similarity: float, sigmas: float = 5.0) -> int:
    """The population count that the XOR of two odd sketches of sets with this similarity stays under, but for `sigmas` deviations."""
    differing = 2 * _SAMPLES * (1 - similarity)
    spread = 2 * math.sqrt(_SAMPLES * similarity * (1 - similarity))
    mean = BITS / 2 * (1 - math.exp(-2 * differing / BITS))
    noise = math.sqrt(BITS / 4 * (1 - math.exp(-4 * differing / BITS)) + (spread * math.exp(-2 * differing / BITS)) ** 2)
    return math.ceil(mean + sigmas * noise)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of texts that lie behind one another, and n + 1 offsets into them."""
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets)
    words = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    full = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        full += words[i : len(words) - SHINGLE + 1 + i] * _STEP[i]
    full = mix64(full)
    out, sizes = [], []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            part = np.sort(full[a : b - SHINGLE + 1])
            part = part[np.append(True, part[1:] != part[:-1])]
        elif b > a:
            part = mix64(np.array([(words[a:b] * _STEP[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            part = words[:0]
        out.append(part)
        sizes.append(len(part))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _digests(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    zero = np.zeros(1, np.uint64)
    return [np.diff(np.concatenate([zero, np.cumsum(x)])[at]).view(np.int64) for x in (mix64(sets ^ np.uint64(0xA5A5)), mix64(sets + np.uint64(0x5A5A)))]


def _samples(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values, one column per non-empty set."""
    low = (sets >> np.uint64(32)).astype(np.uint32)
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((_SAMPLES, len(starts)), np.uint32)
    buffer = np.empty_like(low)
    for k in range(_SAMPLES if len(starts) else 0):
        np.multiply(low, _MUL[k], out=buffer)
        np.add(buffer, _ADD[k], out=buffer)
        out[k] = np.minimum.reduceat(buffer, starts)
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), d1, d2 (digest), keys (one per band; none for an empty set), sketch (BITS bits)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            for lo, hi in chunks(offsets):
                sets, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n, some = np.diff(at), np.diff(at) > 0
                samples = _samples(sets, at).astype(np.uint64)
                count = samples.shape[1]
                keys = np.zeros((count, BANDS), np.uint64)
                for k in range(_SAMPLES):
                    keys[:, k // ROWS] = mix64(keys[:, k // ROWS] * np.uint64(31) + samples[k] + _SALT[k - k % ROWS])
                bit = mix64(samples + _SALT[:, None]) % np.uint64(BITS)
                odd = np.bincount((bit.astype(np.int64) + np.arange(count) * BITS).ravel(), minlength=count * BITS) & 1
                bitmaps = np.zeros((len(n), BITS // 8), np.uint8)
                bitmaps[some] = np.packbits(odd.astype(np.uint8).reshape(count, BITS), axis=1)
                keys_at = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(n), [None, pa.py_buffer(bitmaps.tobytes())]).cast(pa.binary())
                columns = [pa.array(n.astype(np.int64)), *[pa.array(d) for d in _digests(sets, at)]]
                columns += [pa.ListArray.from_arrays(pa.array(keys_at), pa.array(keys.ravel().view(np.int64))), sketch]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), *columns], ["doc_id", "n", "d1", "d2", "keys", "sketch"])

    return rows.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys array<long>, sketch binary")


def _group_links(ids, part, side, sketch, sets, at, percent: int, limit: int) -> list[tuple[int, int]]:
    """Confirmed links that connect parts of one block (side < 0: all pairs) or of two (pairs from different sides)."""
    n, size = len(ids), np.diff(at)
    columns = np.unique(sets, return_inverse=True)[1]
    marked = np.zeros(int(columns.max(initial=-1)) + 1, bool)
    links = []
    for i in range(1, n):
        near = (part[:i] != part[i]) & ((side[:i] != side[i]) | (side[i] < 0))
        near &= 100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i])
        near = np.flatnonzero(near)
        if len(near):
            near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(1) <= limit]
        if not len(near):
            continue
        marked[columns[at[i] : at[i + 1]]] = True
        # one long set at least, many short ones at a time
        cuts = np.flatnonzero(np.diff(np.cumsum(size[near]) // GATHER, prepend=-1))
        for some in np.split(near, cuts[1:]):
            shared = np.add.reduceat(marked[columns[ragged(at[some], size[some])]].astype(np.int64), np.cumsum(size[some]) - size[some])
            for j in some[100 * shared >= percent * (size[some] + size[i] - shared)].tolist():
                if part[j] != part[i]:
                    links.append((int(ids[i]), int(ids[j])))
                    part[part == part[j]] = part[i]
        marked[columns[at[i] : at[i + 1]]] = False
    return links


def _confirm(rows: DataFrame, percent: int, limit: int) -> DataFrame:
    """(src, dst) from rows (cluster, one, two, doc_id, part, side, sketch, shingles) that are grouped by cluster, one, two."""

    def close(group: list[tuple]) -> pa.RecordBatch:
        ids, part, side = (np.array([r[k] for r in group], np.int64) for k in (3, 4, 5))
        sketch = np.frombuffer(b"".join(r[6] for r in group), np.uint64).reshape(len(group), -1)
        sets = [r[7] for r in group]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        links = _group_links(ids, part, side, sketch, np.concatenate(sets), at, percent, limit)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            plain = [batch[c].to_pylist() for c in ("cluster", "one", "two", "doc_id", "part", "side", "sketch")]
            lists = batch["shingles"]
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False)]))
            for k, row in enumerate(zip(*plain, strict=True)):
                if group and group[0][:3] != row[:3]:
                    yield close(group)
                    group = []
                group.append((*row, flat[ends[k] : ends[k + 1]].copy()))
        if group:
            yield close(group)

    keys = ["cluster", "one", "two"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; linked: 100 * intersection >= percent * union of the shingle sets."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    limit = sketch_limit(percent / 100)
    signed = scratch.write(signatures(docs, id_col, text_col))
    linkable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = scratch.write(classes)
    banded = classes.select("rep", F.explode("keys").alias("key"))
    heads = banded.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    together = banded.join(heads, "key").where("rep <> head").select(F.col("rep").alias("src"), F.col("head").alias("dst"))
    clusters = connected_components(together, scratch)
    found = clusters.select(F.col("id").alias("rep"), F.col("component").alias("cluster")).join(classes.select("rep", "n", "d1", "d2", "sketch"), "rep")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    picked = found.join(found.groupBy("cluster").agg(blocks.alias("blocks")), "cluster")
    picked = scratch.write(picked.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    members = scratch.write(_with_sets(docs, picked, id_col, text_col))
    own = members.select("cluster", F.col("block").alias("one"), F.col("block").alias("two"), "doc_id", F.col("doc_id").alias("part"), F.lit(-1).alias("side"), "sketch", "shingles")
    spread = members.where("blocks > 1 AND doc_id = cluster").withColumn("one", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("one <> block")
    spread = spread.select("cluster", "one", F.col("one").alias("two"), "doc_id", F.col("doc_id").alias("part"), F.lit(-1).alias("side"), "sketch", "shingles")
    links = scratch.write(_confirm(own.union(spread), percent, limit))
    large = members.where("blocks > 1")
    if not large.isEmpty():
        parts = connected_components(links, scratch).toDF("part_of", "part")
        large = large.join(parts, F.col("doc_id") == F.col("part_of"), "left").withColumn("part", F.coalesce("part", "doc_id"))
        split = large.groupBy("cluster").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("cluster")
        large = large.join(split, "cluster", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
        across = large.select("cluster", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "doc_id", "part", F.col("block").alias("side"), "sketch", "shingles")
        links = scratch.write(links.union(_confirm(across, percent, limit)))
    final = connected_components(links, scratch)
    classes = classes.select("n", "d1", "d2", "rep").join(final, F.col("rep") == F.col("id"), "left")
    classes = classes.select("n", "d1", "d2", F.coalesce("component", "rep").alias("class_id"))
    out = signed.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _with_sets(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `picked` (rep, cluster, blocks, block, n, d1, d2, sketch) with their full shingle sets, read from the texts again."""
    few = picked.count() <= BROADCAST_ROWS
    ids = picked.select("rep").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("rep"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            for lo, hi in chunks(offsets):
                sets, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), *[pa.array(d) for d in _digests(sets, at)], lists], ["doc_id", "e1", "e2", "shingles"])

    sets = texts.mapInArrow(run, "doc_id long, e1 long, e2 long, shingles array<long>")
    same = (F.col("doc_id") == F.col("rep")) & (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2"))
    return sets.join(picked, same).select("cluster", "blocks", "block", "doc_id", "sketch", "shingles")


#: The same by plain sets in SQL; every pair of documents that shares a shingle is compared.
NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM w UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = w.doc_id AS kept
FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
