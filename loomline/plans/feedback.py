"""Feedback rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATINGS = ("up", "down")


def source_summary(row: Column) -> Column:
    """What a feedback row keeps of a retrieved source."""
    fields = ("source_ref", "chunk_id", "doc_id", "source_type", "record_type", "score", "first_score", "rerank_score")
    return F.struct(*[row[f].alias(f) for f in fields])


def feedback_rows(answers: DataFrame, at: Column) -> DataFrame:
    """created_at, message_id, rating, texts, time and summaries of the ``sources`` array."""
    return answers.select(
        at.alias("created_at"), "message_id", F.lower(F.trim("rating")).alias("rating"), F.trim(F.coalesce("feedback_text", F.lit(""))).alias("feedback_text"), "question", "answer",
        "retrieval_query", F.col("answer_time_seconds").cast("double").alias("answer_time_seconds"), F.transform("sources", source_summary).alias("selected_sources"),
    )


def append_feedback(rows: DataFrame, at: str) -> None:
    """Appends feedback rows to the JSON Lines at ``at``; a rating that is neither up nor down is an error."""
    bad = F.raise_error(F.concat(F.lit("rating must be up or down: "), F.coalesce("rating", F.lit("null"))))
    checked = rows.withColumn("rating", F.when(F.col("rating").isin(*RATINGS), F.col("rating")).otherwise(bad))
    checked.write.mode("append").json(at)
