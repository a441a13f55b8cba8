"""Question-answer data: resume, thread answers, validation, splits, chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import collapse, match_key, overlap_share, trim
from loomline.functions.values import parse_thread


def processed_ids(*logs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Distinct ids that any of the logs names."""
    out = logs[0].select(key)
    for log in logs[1:]:
        out = out.union(log.select(key))
    return out.where(F.col(key).isNotNull()).distinct()


def pending(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that no log names yet."""
    return chunks.join(done.select(key).distinct(), key, "left_anti")


def thread_replies(text: Column) -> Column:
    lines = parse_thread(text)
    return F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))


#: Fixed value: the mode that a pair made from a thread names.
THREAD_MODE = "webex_thread_question_child_messages_answer"


def thread_answer(text: Column, metadata: Column | None = None, user: str = "") -> Column:
    """struct<question_seed, answer, reply_count>: the replies that say something, of one author if ``user`` is given, joined by blank lines.

    The seed is the metadata's thread_start_text, else the first message; null if seed or replies are missing.
    """
    want = " ".join(user.split()).lower()
    named = collapse(metadata["thread_start_text"]) if metadata is not None else F.lit("")

    def of(lines: Column) -> Column:
        replies = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        mine = F.filter(replies, lambda x: (x["message_text"] != "") & (F.contains(match_key(x["author"]), F.lit(want)) if want else F.lit(True)))
        seed = F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.get(lines, F.lit(0))["message_text"], F.lit("")))
        whole = F.struct(seed.alias("question_seed"), F.array_join(F.transform(mine, lambda x: x["message_text"]), "\n\n").alias("answer"), F.size(mine).cast("bigint").alias("reply_count"))
        return F.when(seed.isNotNull() & (F.size(mine) > 0), whole)

    return F.transform(F.array(parse_thread(text)), of)[0]


def thread_answers(chunks: DataFrame, user: str = "") -> DataFrame:
    """(chunk_id, question_seed, answer, reply_count) of the threads that have an answer."""
    meta = F.col("metadata") if "metadata" in chunks.columns else None
    return chunks.select("chunk_id", thread_answer(F.col("text"), meta, user).alias("t")).where("t is not null").select("chunk_id", "t.question_seed", "t.answer", "t.reply_count")


def judge(pairs: DataFrame, pos: str, question: str = "question", answer: str = "answer", context: str = "context", mode: str | None = None, required: tuple[str, ...] = (), least_q: int = 12, least_a: int = 24, most_a: int = 1800, most_thread_a: int = 1800, share: float = 0.08) -> DataFrame:
    """Adds ``reason``: keep, invalid_schema, short_question, answer_length, duplicate_question or weak_grounding, the first that applies.

    ``required``: columns that must not be null. ``mode``: the column with the generation mode; answers from threads have
    a limit of their own, limits <= 0 are off. A question counts as seen from the first row that passes everything else,
    so the duplicate test needs that row's position only: one minimum per question, combined before its shuffle.
    """
    q, a = collapse(F.coalesce(F.col(question), F.lit(""))), collapse(F.coalesce(F.col(answer), F.lit("")))
    thread = F.lower(trim(F.col(mode))) == THREAD_MODE if mode else F.lit(False)
    most = F.when(thread, most_thread_a).otherwise(most_a)
    invalid = F.lit(False)
    for c in required:
        invalid = invalid | F.col(c).isNull()
    rows = pairs.withColumns({"_invalid": invalid, "_key": F.lower(q), "_short": F.length(q) < least_q, "_len": (F.length(a) < least_a) | ((most > 0) & (F.length(a) > most))})
    rows = rows.withColumn("_weak", overlap_share(a, F.col(context)) < share)
    fine = ~F.col("_invalid") & ~F.col("_short") & ~F.col("_len") & ~F.col("_weak")
    first = rows.where(fine).groupBy("_key").agg(F.min(pos).alias("_first"))
    rows = rows.join(first, "_key", "left")
    reason = (
        F.when(F.col("_invalid"), "invalid_schema").when(F.col("_short"), "short_question").when(F.col("_len"), "answer_length")
        .when(F.col(pos) > F.col("_first"), "duplicate_question").when(F.col("_weak"), "weak_grounding").otherwise("keep")
    )
    return rows.withColumn("reason", reason).drop("_invalid", "_key", "_short", "_len", "_weak", "_first")


def exact_split(rows: DataFrame, key: str, seed: int = 42, train: float = 0.9, valid: float = 0.08) -> DataFrame:
    """(key, split_name) with exact sizes int(n * train), int(n * valid), rest, in an order fixed by the seed.

    No global window: the order is the seeded hash, so a row's place is its place in its hash bucket after the counts of
    the buckets before; buckets hold 1/4096 of the rows each.
    """
    ids = rows.select(key).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    ids = ids.withColumn("_b", F.substring("_h", 1, 3))
    counts = ids.groupBy("_b").count()
    order = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("count").over(order), F.lit(0))).withColumn("_n", F.sum("count").over(Window.partitionBy()))
    ranked = ids.join(F.broadcast(starts), "_b").withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * train) + F.floor(F.col("_n") * valid)
    return ranked.select(key, F.when(F.col("_at") <= a, "train").when(F.col("_at") <= b, "valid").otherwise("test").alias("split_name"))


def chat_rows(pairs: DataFrame) -> DataFrame:
    """(qa_id, messages, metadata): pairs as two-message conversations."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), collapse(F.col(c)).alias("content"))
    keep = F.struct("qa_id", "chunk_id", "source_ref", "source_type")
    return pairs.select("qa_id", F.array(turn("user", "question"), turn("assistant", "answer")).alias("messages"), keep.alias("metadata"))


def generation_prompt(text: Column, pairs: int = 2) -> Column:
    return F.concat(F.lit(f"Write {pairs} question and answer pairs that this passage alone can answer, as a JSON array of objects with the keys question and answer.\n\nPassage:\n"), text)


def thread_question_prompt(start: Column, answer: Column) -> Column:
    return F.concat(F.lit("Write the one question that the first message asks and the replies answer, as a JSON object with the key question.\n\nFirst message:\n"), start, F.lit("\n\nReplies:\n"), answer)
