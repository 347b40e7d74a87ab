"""WARC archives: a writer, and a reader that verifies record boundaries as a chain.

Writing: one record per page; of equal payloads of at least MIN_REVISIT bytes the page with the largest id is a response and the
others are revisits that refer to it. Every part file is a WARC file whose first record starts at byte 0.

Reading: Spark's text source cuts the files at every occurrence of the magic line, in byte-range splits, wherever it stands. Each
piece is a candidate record that names its successor: its own offset plus header, Content-Length and the closing blank lines.
Runs of candidates that follow one another directly are one segment; pointer jumping over segments, from the start of
each file, keeps the candidates that the chain reaches. Magic lines inside payloads are not on the chain; their pieces
are put back into the record that they belong to. Offsets are sums in two steps: inside a split, then over a file's splits.

How files are cut into splits depends on the executors of the moment. What one scan finds (no payloads, but the digest of each piece) is
therefore written before anything is made of it, and the bytes of the few pieces that must be put together come from a second scan by their
digests, not by their places in splits.

Nulls and odd cases: a null html is an empty payload; a null url leaves the header out; line breaks in urls become blanks; pages
that share the largest id (ties, repeated rows) are all responses, and so are pages without an id where no equal page has one. Texts may be
of any length that Spark can hold in a string (2 GB). An empty table gives an archive without records. Only the three columns named are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

MAGIC = "WARC/1.1\r\n"
MIN_REVISIT = 1000
#: Payloads with copies (some 100 bytes each) that may be broadcast to the writers.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, response_id (the page that holds the payload; null: this one)."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload")
    )
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("n_bytes") >= min_revisit)
    heads = large.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads = Scratch(pages.sparkSession).write(heads)
    small = heads.count() <= BROADCAST_ROWS  # else the pages are shuffled by digest
    out = rows.join(F.broadcast(heads) if small else heads, ["digest", "n_bytes"], "left")
    return out.withColumn("response_id", F.when(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))).drop("head")


def _urn(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("null")), digest).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Writes the archives; the text sink ends every record with the last of its four closing bytes."""
    r = records(pages, **options)
    revisit = F.col("response_id").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    text = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.coalesce(line("X-Refers-To-Page-ID", F.col("response_id").cast("string")), F.lit("")),
        F.when(revisit, line("WARC-Refers-To", _urn(F.col("response_id"), F.col("digest")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        F.lit("\r\n\r"),
    )
    r.select(text.alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?im)^{name}: *([^\r\n]*)", 1), F.lit(""))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magic lines, with their file, the start of their split and their order in it."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return raw.withColumn("nth", F.monotonically_increasing_id())


def candidates(raw: DataFrame, scratch: Scratch) -> DataFrame:
    """A row per piece: file, offset, successor, parsed header, digests of the piece and of its payload; no payloads."""
    raw = raw.withColumn("bytes", F.octet_length("value").cast("long"))
    raw = raw.withColumn("has_header", F.locate("\r\n\r\n", F.col("value")) > 0)
    raw = raw.withColumn("header", F.when(F.col("has_header"), F.substring_index("value", "\r\n\r\n", 1)))
    raw = raw.withColumn("content", _header("Content-Length").try_cast("long")).withColumn("skip", F.octet_length("header").cast("long") + 4)
    raw = raw.withColumn("span", F.col("skip") + F.col("content") + 4)
    raw = raw.withColumn("whole", F.coalesce(F.col("span") == F.col("bytes"), F.lit(False)))
    body = F.substring(F.col("value").cast("binary"), (F.col("skip") + 1).cast("int"), F.col("content").cast("int"))
    raw = raw.select(
        "file",
        "split",
        "nth",
        "bytes",
        "whole",
        "skip",
        "content",
        (F.lit(len(MAGIC)) + F.col("span")).alias("reach"),
        _header("WARC-Type").alias("type"),
        _header("X-Page-ID").try_cast("long").alias("page_id"),
        _header("WARC-Target-URI").alias("url"),
        _header("X-Refers-To-Page-ID").try_cast("long").alias("refers_to"),
        F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "").alias("stated"),
        F.when(F.col("whole"), F.sha1(body)).alias("digest"),
        F.sha1(F.col("value").cast("binary")).alias("piece"),
    )
    raw = scratch.write(raw)
    in_split = Window.partitionBy("file", "split").orderBy("nth")
    step = F.col("bytes") + len(MAGIC)
    raw = raw.withColumn("local", F.sum(step).over(in_split) - step).withColumn("first", F.row_number().over(in_split) == 1)
    totals = raw.groupBy("file", "split").agg(F.sum(step).alias("total"))
    over = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "split", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"))
    rows = raw.join(totals, ["file", "split"]).withColumn("at", F.col("base") + F.col("local") - len(MAGIC))
    # the text before a file's first magic line starts at -len(MAGIC): no record
    return rows.where("at >= 0").withColumn("next", F.col("at") + F.col("reach")).drop("base", "local", "first", "reach")


def _segments(rows: DataFrame) -> DataFrame:
    """Numbers the runs of candidates that follow one another directly inside a split."""
    w = Window.partitionBy("file", "split").orderBy("at")
    starts = F.coalesce(F.lag("next").over(w) != F.col("at"), F.lit(True)).cast("long")
    return rows.withColumn("starts", starts).withColumn("segment", F.sum("starts").over(w)).drop("starts")


def chain(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The candidates on the chain from each file's start, by pointer jumping over segments; rounds grow with the log of their number."""
    rows = scratch.write(_segments(rows))
    ends = rows.groupBy("file", "split", "segment").agg(F.max_by("next", "at").alias("exit"))
    # an entry is a place where the chain may come into a segment: the start of a file or the target of a segment's last record
    entry = ends.select("file", F.col("exit").alias("at")).union(rows.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    entry = entry.join(rows.select("file", "at", "split", "segment"), ["file", "at"]).join(ends, ["file", "split", "segment"])
    hop = scratch.write(entry.select("file", "at", "split", "segment", F.col("exit").alias("to")))
    reached = scratch.write(hop.where("at = 0").select("file", "at"))
    jump, n = hop.select("file", "at", "to"), reached.count()
    while True:
        onward = reached.join(jump, ["file", "at"]).where(F.col("to").isNotNull()).select("file", F.col("to").alias("at"))
        grown = scratch.write(reached.union(onward).distinct().join(hop.select("file", "at"), ["file", "at"], "left_semi"))
        more = grown.count()
        scratch.drop(reached)
        reached = grown
        if more == n:
            break
        twice = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at")))
        jump, n = scratch.write(twice.select("a.file", "a.at", "b.to")), more
    into = hop.join(reached, ["file", "at"], "left_semi").select("file", "split", "segment", F.col("at").alias("from"))
    return rows.join(into, ["file", "split", "segment"], "left").withColumn("valid", F.coalesce(F.col("at") >= F.col("from"), F.lit(False))).drop("from", "segment")


def read_warc(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, type, refers_to, stated (digest in the header), digest and n_bytes of the record's own block, file, at."""
    scratch = scratch or Scratch(spark)
    raw = pieces(spark, path)
    rows = chain(candidates(raw, scratch), scratch)
    fields = ["file", "at", "page_id", "url", "type", "refers_to", "stated"]
    whole = rows.where("valid AND whole").select(*fields, "digest", F.col("content").alias("n_bytes"))
    # records whose payload holds a magic line: all pieces up to the successor belong to the record
    broken = rows.where("NOT (valid AND whole)")
    in_file = Window.partitionBy("file").orderBy("at")
    broken = broken.withColumn("owner", F.last(F.when(F.col("valid"), F.col("at")), True).over(in_file))
    broken = broken.withColumn("until", F.last(F.when(F.col("valid"), F.col("next")), True).over(in_file)).where("owner IS NOT NULL AND at < until")
    broken = scratch.write(broken)
    if broken.isEmpty():
        return whole
    wanted = broken.select("bytes", "piece").distinct()
    again = raw.select("value", F.octet_length("value").cast("long").alias("bytes")).join(wanted.select("bytes").distinct(), "bytes", "left_semi")
    again = again.withColumn("piece", F.sha1(F.col("value").cast("binary"))).join(wanted, ["bytes", "piece"], "left_semi").dropDuplicates(["bytes", "piece"])
    bytes_of = broken.select("file", "at", "owner", "bytes", "piece").join(again, ["bytes", "piece"])
    bytes_of = bytes_of.select("file", "owner", F.struct("at", F.hex(F.col("value").cast("binary")).alias("p")).alias("piece"))
    joined = bytes_of.groupBy(F.col("file").alias("in_file"), F.col("owner").alias("start")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["p"]), MAGIC.encode().hex().upper()).alias("p")
    )
    stitched = broken.where("valid").join(joined, (F.col("file") == F.col("in_file")) & (F.col("at") == F.col("start")))
    body = F.substring(F.unhex("p"), (F.col("skip") + 1).cast("int"), F.col("content").cast("int"))
    return whole.unionByName(stitched.select(*fields, F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes")))


def archive_round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes pages, reads the archives back and resolves revisits against the responses that were read."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    path = path or f"{scratch.base}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **options)
    got = scratch.write(read_warc(spark, path, scratch))
    responses = got.where("type = 'response'").groupBy(F.col("page_id").alias("to"), F.col("digest").alias("d")).agg(F.max("n_bytes").alias("b"))
    revisits = got.where("type = 'revisit'").join(responses, (F.col("refers_to") == F.col("to")) & (F.col("stated") == F.col("d")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = got.where("type = 'response'").select("page_id", "n_bytes", "digest", "type", F.lit(None).cast("long"))
    return own.union(revisits.select("page_id", "b", "d", "type", "refers_to")).toDF(*columns)


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN head IS NULL OR page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head IS NULL OR page_id IS NOT DISTINCT FROM head THEN NULL ELSE head END AS refers_to
FROM m
"""
