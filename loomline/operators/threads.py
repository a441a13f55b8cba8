"""Chat threads and single messages as document records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import blank_to_null, clip, collapse, stable_id
from loomline.functions.values import instant, message_link, thread_line


def normal_messages(raw: DataFrame) -> DataFrame:
    """Trimmed ids, first text that says something, time as an instant. Rows without id or text are dropped."""
    body = F.coalesce(blank_to_null(F.col("markdown")), blank_to_null(F.col("text")))
    rows = raw.select(
        blank_to_null(F.col("message_id")).alias("message_id"), blank_to_null(F.col("room_id")).alias("room_id"), blank_to_null(F.col("parent_id")).alias("parent_id"),
        F.coalesce(blank_to_null(F.col("author")), blank_to_null(F.col("person_email")), F.lit("unknown")).alias("author"), "created", "updated",
        instant(F.col("created")).alias("at"), instant(F.col("updated")).alias("edited"), collapse(body).alias("body"), "ingested_at",
        blank_to_null(F.col("markdown")).alias("markdown"), (F.col("files") if "files" in raw.columns else F.lit(None)).cast("array<string>").alias("files"),
    )
    return rows.where("message_id is not null and body is not null")


def first_deliveries(messages: DataFrame) -> DataFrame:
    """One row per room and message id: the first delivered, ties by text. A combining aggregate, no window."""
    rest = [c for c in messages.columns if c not in ("room_id", "message_id")]
    order = F.struct("ingested_at", "body", *[c for c in rest if c not in ("ingested_at", "body")])
    return messages.groupBy("room_id", "message_id").agg(F.min(order).alias("m")).select("room_id", "message_id", *[F.col(f"m.{c}") for c in rest])


def threads(raw: DataFrame, least: int = 2) -> DataFrame:
    """(room_id, thread_id, message_count bigint, participants, times, text, start_line, markdown, message_ids, files, start_author, start_text) of threads of at least ``least`` messages.

    A reply belongs to the root that its parent_id names in its room; replies without a root are dropped. Messages follow
    by time, unreadable times last, ties by id. A thread comes together in one row, since its text is one value.
    """
    once = first_deliveries(normal_messages(raw))
    roots = once.where("parent_id is null").select("room_id", F.col("message_id").alias("thread_id"))
    replies = once.where("parent_id is not null").withColumn("thread_id", F.col("parent_id")).join(roots, ["room_id", "thread_id"], "left_semi")
    own = once.where("parent_id is null").withColumn("thread_id", F.col("message_id"))
    whole = own.unionByName(replies, allowMissingColumns=True)
    line = thread_line(F.col("author"), F.col("body"), F.col("created"))
    marked = F.when(F.col("markdown").isNotNull(), thread_line(F.col("author"), F.col("markdown"), F.col("created")))
    key = F.struct((F.col("message_id") != F.col("thread_id")).alias("reply"), F.col("at").isNull().alias("no_time"), "at", "message_id", line.alias("line"), marked.alias("marked"), "files", "author", "body")
    grouped = whole.groupBy("room_id", "thread_id").agg(
        F.count("*").alias("message_count"), F.array_sort(F.collect_set("author")).alias("participants"), F.min("at").alias("created_at"),
        F.max(F.coalesce("edited", "at")).alias("updated_at"), F.array_sort(F.collect_list(key)).alias("lines"),
    )
    kept = grouped.where(F.col("message_count") >= least)
    texts = F.transform("lines", lambda x: x["line"])
    return kept.select(
        "room_id", "thread_id", "message_count", "participants", "created_at", "updated_at", F.array_join(texts, "\n").alias("text"), F.get(texts, F.lit(0)).alias("start_line"),
        F.array_join(F.array_compact(F.transform("lines", lambda x: x["marked"])), "\n").alias("markdown"), F.transform("lines", lambda x: x["message_id"]).alias("message_ids"),
        F.flatten(F.transform("lines", lambda x: F.coalesce(x["files"], F.array().cast("array<string>")))).alias("files"), F.get("lines", F.lit(0))["author"].alias("start_author"), F.get("lines", F.lit(0))["body"].alias("start_text"),
    )


def thread_records(raw: DataFrame, rooms: DataFrame, least: int = 2) -> DataFrame:
    """Document records of threads, with the room's title."""
    titles = room_titles(rooms)
    t = threads(raw, least).join(titles, "room_id", "left")
    ref = F.concat(F.lit("webex::"), F.col("room_id"), F.lit("::thread::"), F.col("thread_id"))
    meta = {
        "room_id": F.col("room_id"), "room_title": F.col("room_title"), "thread_id": F.col("thread_id"), "message_count": F.col("message_count").cast("string"),
        "updated_at": F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "message_ids": F.to_json("message_ids"), "authors": F.to_json("participants"), "files": F.to_json("files"), "is_thread_document": F.lit("true"),
        "webex_grouping": F.lit("thread"), "thread_start_message_id": F.col("thread_id"), "thread_start_author": F.col("start_author"), "thread_start_text": F.col("start_text"), "thread_start_line": F.col("start_line"), "webex_parent_message_link": message_link(F.col("room_id"), F.col("thread_id")),
    }
    pairs = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)])
    return t.select(
        stable_id(ref).alias("doc_id"), F.lit("webex").alias("source_type"), ref.alias("source_ref"), F.lit(None).cast("string").alias("source_path"), F.col("room_title").alias("title"),
        F.lit(None).cast("int").alias("page"), "text", F.nullif("markdown", F.lit("")).alias("markdown"), "created_at", F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != "")).alias("metadata"),
    )


def message_records(raw: DataFrame) -> DataFrame:
    """One record for each delivered message, repeated deliveries included; message_count is 1."""
    m = normal_messages(raw)
    ref = F.concat(F.lit("webex::"), F.coalesce("room_id", F.lit("")), F.lit("::message::"), F.col("message_id"))
    return m.select(stable_id(ref).alias("doc_id"), ref.alias("source_ref"), F.coalesce("parent_id", "message_id").alias("thread_id"), "author", F.col("at").alias("created_at"), F.col("body").alias("text"), F.lit(1).cast("bigint").alias("message_count"))


def room_titles(rooms: DataFrame, kind: str = "all") -> DataFrame:
    """(room_id, room_title) of the rooms of a kind (group, direct, all), first row per id by title."""
    picked = rooms if kind == "all" else rooms.where(F.lower("room_type") == kind)
    return picked.groupBy("room_id").agg(F.min(collapse(F.col("title"))).alias("room_title"))


def history(turns: DataFrame, key: str, order: str, role: str, text: str, most: int, most_chars: int = 0, most_tokens: int = 0) -> DataFrame:
    """(key, history): the last ``most`` exchanges of users and assistants as ROLE: text lines, clipped to the limits that are > 0."""
    from loomline.plans.budget import clip_tokens

    said = turns.where(F.col(role).isin("user", "assistant") & blank_to_null(F.col(text)).isNotNull())
    back = Window.partitionBy(key).orderBy(F.desc(order))
    last = said.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= 2 * most)
    line = F.concat(F.upper(role), F.lit(": "), F.trim(text))
    out = last.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))
    out = out.withColumn("history", clip(F.col("history"), most_chars)) if most_chars > 0 else out
    return out.withColumn("history", clip_tokens(F.col("history"), most_tokens)) if most_tokens > 0 else out
