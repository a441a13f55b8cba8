"""Question-answer pairs from chunks by a generator, resumable: every chunk that was judged leaves a progress row.

A chunk whose generation fails leaves none, so the next run takes it again. Chunks are judged independently of each
other; the generator runs in Arrow batches on the executors and is the only part outside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import blank_to_null, collapse, match_key, stable_id, trim
from loomline.functions.values import parse_thread, qa_pairs, question_of
from loomline.models import Generator, generate
from loomline.operators.qa import THREAD_MODE, generation_prompt, pending, thread_answer, thread_question_prompt
from loomline.session import _hadoop_path

STATUSES = ("completed", "skipped_short_webex", "skipped_webex_user_filter", "skipped_webex_thread_without_answer", "no_valid_qa", "filtered_after_validation")


@dataclass(frozen=True)
class GenerationConfig:
    pairs_per_chunk: int = 2
    least_question: int = 12
    least_answer: int = 24
    most_answer: int = 1800
    most_thread_answer: int = 1800
    least_chat_chars: int = 200
    user: str = ""


def first_chunks(chunks: DataFrame, most: int, pos: str) -> DataFrame:
    """The ``most`` first chunks by ``pos`` (<= 0: all) that say something, with their length."""
    rows = chunks.withColumn("length", F.length(trim(F.coalesce("text", F.lit(""))))).where("length > 0")
    return rows.orderBy(pos).limit(most) if most > 0 else rows


def is_chat(source_type: Column) -> Column:
    return F.lower(trim(F.coalesce(source_type, F.lit("")))) == "webex"


def is_chat_thread(source_type: Column, metadata: Column) -> Column:
    """Whether a chunk is a whole thread of more than one message."""
    many = F.coalesce(metadata["message_count"].try_cast("int"), F.lit(0)) > 1
    return is_chat(source_type) & metadata["thread_id"].isNotNull() & many


def matches_user(source_type: Column, metadata: Column, text: Column, user: str) -> Column:
    """Whether a chat chunk has to do with ``user`` (part of a name, case and spaces apart; '' matches all).

    A thread: an author of a reply. Else person_name, person_email or author of the metadata, or the author of a line.
    """
    want = " ".join(user.split()).lower()
    if not want:
        return F.lit(True)
    has = lambda c: F.coalesce(F.contains(match_key(c), F.lit(want)), F.lit(False))
    lines = parse_thread(text)
    replies = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    named = has(metadata["person_name"]) | has(metadata["person_email"]) | has(metadata["author"])
    known = F.filter(lines, lambda x: x["author"] != "unknown-user")
    single = named | F.exists(known, lambda x: has(x["author"]))
    return F.when(is_chat_thread(source_type, metadata), F.exists(replies, lambda x: has(x["author"]))).otherwise(single)


def judged_chunks(chunks: DataFrame, model: Generator, cfg: GenerationConfig = GenerationConfig()) -> DataFrame:
    """Chunks with ``status`` and ``pairs`` (array<struct<question, answer>>, only those that pass); failed ones are left out.

    A thread asks for one question to its replies; any other chunk for ``pairs_per_chunk`` pairs.
    """
    meta, kind, text = F.col("metadata"), F.col("source_type"), trim(F.coalesce("text", F.lit("")))
    rows = chunks.withColumns({"_text": text, "_thread": F.coalesce(is_chat_thread(kind, meta), F.lit(False)), "_reply": thread_answer(F.col("text"), meta, cfg.user)})
    skip = (
        F.when(is_chat(kind) & (F.length("_text") < cfg.least_chat_chars), "skipped_short_webex")
        .when(is_chat(kind) & ~matches_user(kind, meta, F.col("text"), cfg.user), "skipped_webex_user_filter")
        .when(F.col("_thread") & F.col("_reply").isNull(), "skipped_webex_thread_without_answer")
    )
    rows = rows.withColumn("_skip", skip)
    ask = F.when(F.col("_thread"), thread_question_prompt(F.col("_reply.question_seed"), F.col("_reply.answer"))).otherwise(generation_prompt(F.col("_text"), cfg.pairs_per_chunk))
    rows = rows.withColumn("_out", generate(F.when(F.col("_skip").isNull(), ask), model)).where("_skip is not null or _out is not null")
    own = F.array(F.struct(F.coalesce(question_of(F.col("_out")), F.lit("")).alias("question"), F.col("_reply.answer").alias("answer")))
    found = F.when(F.col("_skip").isNotNull(), F.array().cast("array<struct<question:string,answer:string>>")).when(F.col("_thread"), own).otherwise(qa_pairs(F.col("_out")))
    most = F.when(F.col("_thread"), cfg.most_thread_answer).otherwise(cfg.most_answer)
    fits = lambda p: (F.length(p["question"]) >= cfg.least_question) & (F.length(p["answer"]) >= cfg.least_answer) & ((most <= 0) | (F.length(p["answer"]) <= most))
    numbered = F.transform("_found", lambda p, i: F.struct(i.alias("no"), p["question"].alias("question"), p["answer"].alias("answer")))
    rows = rows.withColumn("_found", F.coalesce(F.filter(found, lambda p: p["question"] != ""), F.array().cast("array<struct<question:string,answer:string>>"))).withColumn("pairs", F.filter(numbered, fits))
    status = F.when(F.col("_skip").isNotNull(), F.col("_skip")).when(F.size("_found") == 0, "no_valid_qa").when(F.size("pairs") == 0, "filtered_after_validation").otherwise("completed")
    return rows.withColumn("status", status)


def pair_records(judged: DataFrame, cfg: GenerationConfig = GenerationConfig()) -> DataFrame:
    """The records of the pairs, linked to their chunk."""
    rows = judged.select("chunk_id", "doc_id", "source_ref", "source_type", "_text", "metadata", "_thread", "_reply", F.explode("pairs").alias("p"))
    only = lambda c: F.when(F.col("_thread"), c)
    meta = F.struct(
        F.col("_text").alias("chunk_text"), F.col("metadata").alias("chunk_metadata"), only(F.lit(THREAD_MODE)).alias("qa_generation_mode"),
        only(F.coalesce(trim(F.col("metadata")["thread_start_text"]), F.lit(""))).alias("thread_start_text"), only(F.col("_reply.reply_count").cast("int")).alias("thread_reply_count"), only(F.lit(cfg.user)).alias("thread_reply_user_filter"),
    )
    return rows.select(stable_id(F.col("chunk_id"), F.col("p.no"), F.col("p.question")).alias("qa_id"), "p.question", "p.answer", "chunk_id", "doc_id", "source_ref", "source_type", meta.alias("metadata"))


def progress_rows(judged: DataFrame) -> DataFrame:
    return judged.select("chunk_id", "doc_id", "source_ref", "source_type", "status", F.size("pairs").cast("int").alias("qa_row_count"))


def reset(spark: SparkSession, *places: str) -> None:
    """Removes the outputs of earlier runs."""
    for at in places:
        path, fs = _hadoop_path(spark, at)
        fs.delete(path, True)


def run_generation(spark: SparkSession, chunks: DataFrame, pairs_at: str, progress_at: str, model: Generator, cfg: GenerationConfig = GenerationConfig(), resume: bool = True, most: int = 0, pos: str = "chunk_id") -> dict[str, int]:
    """Appends pairs and progress of the chunks that no earlier run judged; gives the number of chunks by status.

    Progress is written after the pairs. A run that dies between the two repeats its chunks: their pairs have the same
    ids, so ``plans.index.latest`` and ``operators.qa`` count them once.
    """
    if not resume:
        reset(spark, pairs_at, progress_at)
    todo = first_chunks(chunks, most, pos)
    path, fs = _hadoop_path(spark, progress_at)
    if fs.exists(path):
        todo = pending(todo, spark.read.parquet(progress_at).select("chunk_id"))
    from loomline.session import Stage

    stage = Stage(judged_chunks(todo, model, cfg), "judged")  # the generator runs once for both sinks
    pair_records(stage.df, cfg).write.mode("append").parquet(pairs_at)
    progress_rows(stage.df).write.mode("append").parquet(progress_at)
    counts = {r["status"]: r["count"] for r in stage.df.groupBy("status").count().collect()}
    stage.drop()
    return counts
