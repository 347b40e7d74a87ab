"""Chat formatting: every participant of a dialogue in turn becomes the assistant. DataFrame functions only.

One row per dialogue, perspective and turn: the rendered segment, where it lies in the rendered dialogue, and the span that
training counts. The dialogue of one perspective is the concatenation of its segments in order of `position`; segments rather
than whole dialogues are the rows because one dialogue may hold a large part of all turns.

Format: ``<|im_start|>assistant\\n{text}<|im_end|>\\n`` for the perspective's own turns, ``<|im_start|>user name={speaker}\\n...``
for others, ``<|im_start|>system\\n...`` for turns of the system, which has no perspective. The counted span is an own turn's
text with its ``<|im_end|>``. A literal ``<|`` in texts or names is broken as ``<\\|``; line breaks in names become blanks.

Order: by turn, then speaker, then text, nulls first; equal rows stay apart. A null text is empty; a turn without a speaker is
rendered for others as user ``unknown`` and gives no perspective; turns with a null dialogue id make up one dialogue. A dialogue
without participants, like an empty table, gives no rows. Texts may be of any length that Spark can hold in a string (2 GB): a row is one turn.
Only the four columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that one window holds for the running sums; a second window adds up the blocks before.
BLOCK = 1024


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system"
) -> DataFrame:
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(speaker_col).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    seats = (
        rows.where(F.col("speaker").isNotNull() & (F.col("speaker") != system))
        .select(F.col("conv_id").alias("seat_conv"), F.col("speaker").alias("assistant"))
        .distinct()
    )
    seen = rows.join(seats, F.col("conv_id").eqNullSafe(F.col("seat_conv"))).drop("seat_conv")
    own = F.coalesce(F.col("speaker") == F.col("assistant"), F.lit(False))
    name = _safe(F.regexp_replace(F.coalesce("speaker", F.lit("unknown")), r"[\r\n]", " "))
    role = F.when(own, F.lit("assistant")).when(F.col("speaker") == system, F.lit("system")).otherwise(F.concat(F.lit("user name="), name))
    head = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))
    seen = seen.withColumn("is_target", own).withColumn("head", head).withColumn("segment", F.concat("head", _safe(F.col("text")), F.lit("<|im_end|>\n")))
    seen = seen.withColumn("n_chars", F.length("segment").cast("long")).withColumn("head_chars", F.length("head").cast("long")).drop("head")
    seen = seen.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "assistant", "block").orderBy("turn", "speaker", "text")
    seen = seen.withColumn("nth", F.row_number().over(inside).cast("long"))
    seen = seen.withColumn("before", F.sum("n_chars").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_chars"))
    blocks = seen.groupBy("conv_id", "assistant", "block").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    earlier = Window.partitionBy("conv_id", "assistant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"),
        F.col("assistant").alias("b_assistant"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_earlier"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_earlier"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("assistant") == F.col("b_assistant")) & F.col("block").eqNullSafe(F.col("b_block"))
    start = F.col("chars_earlier") + F.col("before")
    return seen.join(blocks, same).select(
        "conv_id",
        "assistant",
        (F.col("n_earlier") + F.col("nth")).alias("position"),
        "turn",
        "speaker",
        "segment",
        "is_target",
        start.alias("start_char"),
        (start + F.col("n_chars")).alias("end_char"),
        F.when(F.col("is_target"), start + F.col("head_chars")).alias("target_start"),
        F.when(F.col("is_target"), start + F.col("n_chars") - 1).alias("target_end"),
    )


CHAT_SQL = r"""
WITH r AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, speaker AS assistant FROM r WHERE speaker IS NOT NULL AND speaker <> 'system'),
v AS (
  SELECT r.*, s.assistant, coalesce(r.speaker = s.assistant, false) AS is_target,
         '<|im_start|>' || CASE WHEN r.speaker = s.assistant THEN 'assistant' WHEN r.speaker = 'system' THEN 'system'
           ELSE 'user name=' || replace(regexp_replace(coalesce(r.speaker, 'unknown'), '[\r\n]', ' ', 'g'), '<|', '<\|') END || chr(10) AS head
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
g AS (SELECT *, head || replace(text, '<|', '<\|') || '<|im_end|>' || chr(10) AS segment FROM v),
o AS (
  SELECT *, row_number() OVER w AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS end_char FROM g
  WINDOW w AS (PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, assistant, position, turn, speaker, segment, is_target, end_char - length(segment) AS start_char, end_char,
       CASE WHEN is_target THEN end_char - length(segment) + length(head) END AS target_start,
       CASE WHEN is_target THEN end_char - 1 END AS target_end
FROM o
"""
