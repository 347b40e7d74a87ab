"""The registered queries of the training-data operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import CHAT_SQL, rotate_perspectives
from .common import table
from .metricjoin import EMBEDDING_SQL, embedding_duplicates
from .mixing import MIX_SQL, systematic_mix
from .neardup import NEARDUP_SQL, near_duplicates
from .ppm import score_documents
from .tokencount import token_counts
from .toxicity import score_table
from .topk import TOPK_SQL, exact_top_k
from .unigram import round_trip_table
from .warc import WARC_SQL, archive_round_trip


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_table(spark, sf_dir)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_table(spark, sf_dir)


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op9_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systematic_mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_exact_top_k, op4_toxicity, op5_ppm, op6_near_duplicates, op7_embedding_duplicates, op8_chat_perspectives, op9_warc_chain, op10_systematic_mix)
}

ORACLES: dict[str, str] = {
    "op3_exact_top_k": TOPK_SQL,
    "op6_near_duplicates": NEARDUP_SQL,
    "op7_embedding_duplicates": EMBEDDING_SQL,
    "op8_chat_perspectives": CHAT_SQL,
    "op9_warc_chain": WARC_SQL,
    "op10_systematic_mix": MIX_SQL,
}
