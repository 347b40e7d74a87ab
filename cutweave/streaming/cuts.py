"""Streams of cut lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_bag, as_line, parse_ids


def distinct_cut_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct cut (sorted bag, empty lines left out) of the files that arrive in a folder, once; the state holds the cuts seen."""
    return distinct_cuts(spark.readStream.text(folder))


def distinct_cuts(lines: DataFrame) -> DataFrame:
    """Works on a stream and on a batch of (value)."""
    return lines.where(F.trim("value") != "").select(as_line(as_bag(parse_ids(F.col("value")))).alias("cut")).dropDuplicates(["cut"])
