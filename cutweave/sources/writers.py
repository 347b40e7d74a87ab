"""Lines of the output formats, and writers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_line, general, line_size


def cut_text(cuts: DataFrame) -> DataFrame:
    return cuts.select(as_line(F.col("edges")).alias("value"))


def write_cuts(cuts: DataFrame, path: str) -> None:
    cut_text(cuts).write.mode("overwrite").text(path)


def edge_text(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(";", "id", "src", "dst").alias("value"))


def write_edges(edges: DataFrame, path: str) -> None:
    edge_text(edges).write.mode("overwrite").text(path)


def write_graphs(graphs: DataFrame, path: str) -> None:
    """(graph_id, id, src, dst) -> one folder graph_id=n of edge lines per graph."""
    graphs.select("graph_id", F.concat_ws(";", "id", "src", "dst").alias("value")).write.mode("overwrite").partitionBy("graph_id").text(path)


def dot_text(edges: DataFrame, name: str = "G") -> DataFrame:
    """(line, value): an undirected graph for GraphViz, edges labelled with their ids, in order of line."""
    one = edges.sparkSession.range(1)
    body = edges.select((F.col("id").cast("long") + 1).alias("line"), F.format_string('\t%d -- %d [label = "%d"];', "src", "dst", "id").alias("value"))
    head = one.select(F.lit(-(2**62)).alias("line"), F.lit(f"graph {name} {{").alias("value"))
    return head.union(body).union(one.select(F.lit(2**62).alias("line"), F.lit("}").alias("value")))


def write_by_size(lines: DataFrame, path: str) -> None:
    """(value) -> one folder size=n per cut size; commas in parentheses do not count."""
    lines.withColumn("size", line_size(F.col("value"))).write.mode("overwrite").partitionBy("size").text(path)


def write_log(rows: DataFrame, path: str, sep: str = "\t") -> None:
    rows.select(F.concat_ws(sep, *rows.columns).alias("value")).write.mode("overwrite").text(path)


def tex_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return rows.select(*rows.columns, F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("value"))


def quartile_text(report: DataFrame) -> DataFrame:
    """A TeX line per quartile of operators.reports.quartile_report(): its share of records, its bounds, records and bonds; numbers as %g writes them."""
    share = lambda q: general((F.col("quartile") + q) / F.lit(4.0))
    cells = [F.concat_ws("\t&\t", share(0), share(1)), F.concat_ws("\t&\t", general(F.col("low")), general(F.col("high"))), F.col("records").cast("string"), F.col("bonds").cast("string")]
    return report.select("quartile", F.concat(F.concat_ws("\t& ", *cells), F.lit(r" \\")).alias("value"))
