"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's target is a number of words. Every document of a source expects target / source size copies. Documents are laid
out within their source by size, then by a hash of their id; the running sum of expected copies, plus one random offset per
source, emits a document once per integer boundary that it crosses. As the documents lie in order of size, the words that are
taken differ from the target by about the largest document of the source at most.

The position of a document is the sum of three bounded parts, so that no window holds a whole source: documents of smaller
sizes (one row per distinct size), smaller hash buckets of the same size (at most BUCKETS rows), smaller hashes in the bucket.

Nulls: a null text has size 0, a null source is a source of its own that comes last, a document without id hashes by its text.
Ties: documents of equal size and id lie by the digest of their text; rows equal in all that are next to each other in any order, which makes no
difference. Repeated rows are documents of their own. Texts of any length are counted whole. An empty table gives an empty result. Only the
columns named are read; others may be carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

BUCKETS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(src, src_null, source_size) -> the same with target.

    Water filling in one pass: in order of cap / weight, a source is capped if the level that the rest would get lies above its
    own ratio; the level of the first source that is not capped holds for all the others. One row per source is sorted.
    """
    by_code_point = Window.orderBy("src_null", "src")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("w", F.element_at(pick, ((F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", "src_null", "src")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn(
        "level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    )
    rows = rows.withColumn("capped", F.col("level") >= F.col("ratio"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return rows.select("src", "src_null", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("w")).alias("target"))


def systematic_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix-1",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, and `carry` as a struct `kept`."""
    src, src_null = F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.col(source_col).isNull()
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("/"), F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        src.alias("src"),
        src_null.alias("src_null"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")).alias("hash"),
        F.xxhash64(F.col(text_col)).alias("tie"),
        *([F.struct(*[F.col(c) for c in carry]).alias("kept")] if carry else []),
    ).withColumn("bucket", (F.conv(F.substring("hash", 1, 4), 16, 10).cast("int") % BUCKETS))
    if not carry:
        rows = Scratch(docs.sparkSession).write(rows)  # texts are read once, what follows reads some 60 bytes a document
    by_bucket = rows.groupBy("src", "src_null", "size", "bucket").agg(F.count("*").alias("n"))
    by_size = by_bucket.groupBy("src", "src_null", "size").agg(F.sum("n").alias("n"))
    by_source = by_size.groupBy("src", "src_null").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    smaller = by_size.select("src", "src_null", "size", ahead(Window.partitionBy("src", "src_null").orderBy("size")).alias("smaller"))
    earlier = by_bucket.select("src", "src_null", "size", "bucket", ahead(Window.partitionBy("src", "src_null", "size").orderBy("bucket")).alias("earlier"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "src", F.col("src_null").cast("string")).cast("binary")), 1, 4), 16, 10).cast("double") / F.lit(65536.0)
    place = earlier.join(smaller, ["src", "src_null", "size"]).join(targets(by_source, weights, share, cap), ["src", "src_null"])
    place = place.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("offset", offset)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("src", "src_null", "size", "bucket").orderBy("hash", "doc_id", "tie")))
    at = F.col("smaller") + F.col("earlier") + F.col("rank")
    crossed = F.floor(F.col("rate") * at + F.col("offset")) - F.floor(F.col("rate") * (at - 1) + F.col("offset"))
    out = ranked.join(place, ["src", "src_null", "size", "bucket"]).withColumn("copies", crossed.cast("long"))
    return out.select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["kept"] if carry else [])
    )


MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS src_null,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '/' || coalesce(text, ''))) AS hash
  FROM documents),
s AS (SELECT src, src_null, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src, src_null),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY src_null, src) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
         - coalesce(sum(most) OVER (ORDER BY ratio, src_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY ratio, src_null, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT src, src_null, source_size,
         CASE WHEN level >= ratio THEN most ELSE (SELECT max(level) FROM l WHERE level < ratio) * w END AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.src, d.src_null ORDER BY size, CAST(('0x' || substr(hash, 1, 4)) AS INTEGER) % {BUCKETS}, hash, doc_id) AS pos,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(('0x' || substr(md5('mix-1/' || d.src || CASE WHEN d.src_null THEN 'true' ELSE 'false' END), 1, 4)) AS INTEGER) / 65536.0::DOUBLE AS u
      FROM d JOIN t ON d.src = t.src AND d.src_null = t.src_null)
SELECT doc_id, size, source_size, target,
       CAST(floor(rate * pos + u) - floor(rate * (pos - 1) + u) AS BIGINT) AS copies,
       CAST(floor(rate * pos + u) - floor(rate * (pos - 1) + u) AS BIGINT) * size AS taken
FROM p
"""
