"""Readers. Malformed input raises instead of being guessed at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import parse_ids


def read_edges(spark: SparkSession, path: str, header: bool = False, sep: str = ";") -> DataFrame:
    """id;source;target[;...]: further fields are ignored, blank lines skipped, other text and negative nodes raise."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    if header:
        rows = rows.where(~F.col("value").rlike(r"^\s*[A-Za-z_]"))
    return edge_lines(rows, sep)


def edge_lines(lines: DataFrame, sep: str = ";") -> DataFrame:
    part = F.split("value", "[;,]" if sep == ";," else rf"\Q{sep}\E")
    number = lambda i: F.trim(F.get(part, i)).cast("int")
    rows = lines.select(number(0).alias("id"), number(1).alias("src"), number(2).alias("dst"), "value")
    bad = F.col("id").isNull() | F.col("src").isNull() | F.col("dst").isNull() | (F.col("src") < 0) | (F.col("dst") < 0)
    return rows.select(F.when(bad, F.raise_error(F.concat(F.lit("no edge: "), "value"))).otherwise(F.col("id")).alias("id"), "src", "dst")


def read_osm_edges(spark: SparkSession, path: str) -> DataFrame:
    """First three columns of a comma-separated extract with a header, where the fifth is greater than "1" as text."""
    rows = spark.read.option("header", True).csv(path)
    return osm_filter(rows)


def osm_filter(rows: DataFrame) -> DataFrame:
    a, b, c, _, kind = rows.columns[:5]
    return rows.where(F.col(kind).cast("string") > F.lit("1")).select(F.col(a).cast("int").alias("id"), F.col(b).cast("int").alias("src"), F.col(c).cast("int").alias("dst"))


def graph6_edges(lines: DataFrame, edge_order: str = "col") -> DataFrame:
    """(graph_id, g6) -> (graph_id, n, id, src, dst); ids count the upper triangle by columns ('col') or rows ('row').

    Sizes of one, four and eight bytes; sparse6 lines and characters outside the format raise. A graph without edges gives no rows.
    """
    if edge_order not in ("col", "row"):
        raise ValueError(f"unknown edge order {edge_order}")
    text = F.regexp_replace(F.trim("g6"), "^>>graph6<<", "")
    valid = text.rlike("^[?-~]+$")
    checked = F.when(valid, text).otherwise(F.raise_error(F.concat(F.lit("no graph6 line: "), "g6")))
    rows = lines.select("graph_id", checked.alias("t")).withColumn("six", F.transform(F.split("t", ""), lambda c: F.ascii(c) - 63)).withColumn("six", F.filter("six", lambda x: x >= 0))
    skip = F.when(F.get("six", 0) < 63, 1).when(F.get("six", 1) < 63, 4).otherwise(8)
    first = F.when(F.get("six", 0) < 63, 0).when(F.get("six", 1) < 63, 1).otherwise(2)
    rows = rows.withColumn("skip", skip).withColumn("first", first)
    size = F.aggregate(F.slice("six", F.col("first") + 1, F.col("skip") - F.col("first")), F.lit(0).cast("long"), lambda a, x: a * 64 + x)
    rows = rows.withColumn("n", size.cast("int"))
    bits = F.flatten(F.transform(F.slice("six", F.col("skip") + 1, F.size("six")), lambda x: F.transform(F.sequence(F.lit(5), F.lit(0), F.lit(-1)), lambda s: F.floor(x / F.pow(F.lit(2), s)).cast("int") % 2)))
    rows = rows.select("graph_id", "n", F.posexplode(bits).alias("bit", "on")).where("on = 1")
    # bit b of the upper triangle by columns: column j holds the bits j(j-1)/2 .. j(j+1)/2 - 1
    j = F.floor((F.sqrt(F.col("bit") * 8 + 1) + 1) / 2).cast("int")
    rows = rows.withColumn("dst", j).withColumn("src", (F.col("bit") - F.col("dst") * (F.col("dst") - 1) / 2).cast("int")).where("dst < n")
    order = ["dst", "src"] if edge_order == "col" else ["src", "dst"]
    number = F.row_number().over(Window.partitionBy("graph_id").orderBy(*order)) - 1
    return rows.select("graph_id", "n", number.alias("id"), "src", "dst")


def read_cuts(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, edges); '~' is the empty relation. Line numbers rise with the position in a file."""
    if path == "~":
        return spark.createDataFrame([], schemas.CUTS)
    return cut_lines(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()))


def cut_lines(lines: DataFrame) -> DataFrame:
    """(line_no, value) -> (line_no, edges)."""
    return lines.select(F.col("line_no").cast("long").alias("line_no"), parse_ids(F.col("value")).alias("edges"))


def inline_cut(spark: SparkSession, text: str) -> DataFrame:
    return cut_lines(spark.createDataFrame([(0, text)], "line_no long, value string"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """id;u;v;name[;...] with the line number that decides between equal names."""
    part = F.split("value", ";", -1)
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.get(part, 0).cast("int").alias("id"), F.get(part, 1).cast("int").alias("u"), F.get(part, 2).cast("int").alias("v"), F.get(part, 3).alias("name"), F.monotonically_increasing_id().alias("line_no"))


def name_lists(lines: DataFrame) -> DataFrame:
    """(line_no, value) -> (line_no, names): fields by ';' without the last three."""
    part = F.split("value", ";", -1)
    return lines.select("line_no", F.slice(part, F.lit(1), F.greatest(F.lit(0), F.size(part) - 3)).alias("names"))


def _table(lines: DataFrame, schema) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return rows.select(*[F.get(part, i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def runtime_log(lines: DataFrame) -> DataFrame:
    return _table(lines, schemas.RUNTIME_LOG)


def path_log(lines: DataFrame) -> DataFrame:
    return _table(lines, schemas.PATH_LOG)


def grid_table(lines: DataFrame) -> DataFrame:
    return _table(lines, schemas.GRID)


def noncanonicity_table(lines: DataFrame) -> DataFrame:
    return _table(lines, schemas.NONCANONICITY)


def parse_bounds(text: str, least: int) -> tuple[int, int]:
    """'x-y' -> (x, y); a single number is the maximum, with `least` as the minimum."""
    low, dash, high = text.partition("-")
    return (int(low), int(high)) if dash else (least, int(low))
