"""Documents to training tokens: drop toxic texts, keep one of each group of near duplicates, mix sources, encode.

STAGES lists the stages; each takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns the columns of
docs, the last one the encoded rows. run() applies them in order and writes every result to the cluster's shared folder.

Null texts count as empty. Rows that share an id but not their text, and rows without id, are documents of their own; repeated rows (equal id
and text) are one, of which the smallest row by its columns stays (ties: equal rows, any). Texts of any length are handled whole. An empty
table gives an empty result. Extra columns are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutweave.llm.common import Scratch, table
from cutweave.llm.mixing import systematic_mix
from cutweave.llm.neardup import near_duplicates
from cutweave.llm.toxicity import learn, score
from cutweave.llm.unigram import round_trip


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from `labels`, does not predict as toxic."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, carry=docs.columns).where("is_toxic = 0").select("kept.*")


#: Documents that ids do not tell apart are numbered from here on, so that of a group a document with an id of its own stays.
UNNAMED = 1 << 62


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id: five-word shingles, a similarity of 0.8 or more."""
    scratch = Scratch(spark)
    narrow = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    per_id = narrow.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where("n > 1 OR doc_id IS NULL")
    repeated = scratch.write(per_id.select(F.col("doc_id").cast("long").alias("shared_id"), "texts"))
    if repeated.isEmpty():  # every id names a document
        kept = near_duplicates(docs, percent=80).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    body = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), body.alias("body"))
    text = F.coalesce("text", F.lit(""))
    number = F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64(F.col("id"), text, F.lit("text")), 2)
    clash = repeated.where("shared_id IS NOT NULL AND texts > 1").select("shared_id")
    rows = rows.join(clash, F.col("id") == F.col("shared_id"), "left")
    rows = scratch.write(rows.select(F.when(F.col("id").isNotNull() & F.col("shared_id").isNull(), F.col("id")).otherwise(number).alias("doc_id"), "text", "body"))
    kept = near_duplicates(rows, percent=80).where("kept").select("doc_id").distinct()
    plain = [f"body.`{c}`" for c, kind in docs.dtypes if not kind.startswith("map")]
    one = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in plain])
    rows = rows.join(kept, "doc_id", "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return rows.select("body.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = systematic_mix(docs, carry=docs.columns).where("copies > 0")
    return mixed.select("kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("kept.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, log_score, decoded_sha1, round_trip of every document of the mix."""
    return round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learned lexicon and Viterbi segmentation are beyond SQL; tests/llm/test_pipeline.py checks run() against plain Python.
ORACLE_SQL: str | None = None
