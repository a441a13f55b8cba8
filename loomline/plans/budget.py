"""Prompt budgets: context rows, context text, history, prompts. All of it runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import MARKER, clip, rtrim, token_count, trim

#: A cut takes three characters for each token too many. As a token has at most four characters by the estimate, each
#: round leaves at most a quarter of the excess (or takes eight characters), so this many rounds fit any text.
ROUNDS = 40


def _bind(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _fitted(text: Column, most: Column) -> Column:
    """The longest beginning that the rounds of cutting leave, with at most ``most`` tokens; '' if none fits."""
    sized = lambda t: _bind(t, lambda x: F.struct(x.alias("text"), (token_count(x) - most).alias("over")))
    shorter = lambda s: rtrim(F.substring(s["text"], F.lit(1), F.greatest(F.length(s["text"]) - F.greatest(F.lit(8), 3 * s["over"]), F.lit(0))))
    cut = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), sized(text), lambda s, _: F.when(s["over"] > 0, sized(shorter(s))).otherwise(s), lambda s: s["text"])
    return F.when(most > 0, cut).otherwise("")


def clip_tokens(text: Column, most: int | Column, marker: str = MARKER) -> Column:
    """At most ``most`` estimated tokens (<= 0: no limit): a proportional cut, shortened until it fits, then the marker if it fits."""
    limit = most if isinstance(most, Column) else F.lit(most)
    extra = len(_marks(marker))

    def clipped(both: Column) -> Column:
        clean, total = both["clean"], both["total"]
        share = F.greatest(F.lit(1), F.floor(F.length(clean) * (limit / F.greatest(total, F.lit(1)))).cast("int"))
        start = rtrim(F.substring(clean, F.lit(1), share))
        bare = _fitted(start, limit)
        marked = _bind(_fitted(start, limit - extra), lambda c: F.when(c != "", F.concat(c, F.lit(marker))).otherwise(F.lit(marker.strip() or marker)))
        return F.when((limit <= 0) | (total <= limit), clean).otherwise(F.when(F.lit(extra) < limit, marked).otherwise(bare) if marker else bare)

    clean = trim(F.coalesce(text, F.lit("")))
    return _bind(_bind(clean, lambda c: F.struct(c.alias("clean"), token_count(c).alias("total"))), clipped)


def _marks(text: str) -> list[str]:
    """The pieces of a short constant text, as the estimate counts them."""
    import re

    pieces = re.findall(r"\w+|[^\w\s]", text)
    return pieces if len(pieces) >= len(text.strip()) // 4 else [""] * (len(text.strip()) // 4)


def clip_tokens_column(text: Column, most: int) -> Column:
    return F.when(text.isNotNull(), clip_tokens(text, most))


def fitting(texts: Column, rows: int, chunk_chars: int, total_chars: int, chunk_tokens: int = 0, total_tokens: int = 0) -> Column:
    """array<struct<i, text>>: place and text of the ``texts`` that fit, in order; limits <= 0 are off, the last one is cut to what is left."""

    def left(acc: Column) -> Column:
        open_ = F.lit(True)
        if rows > 0:
            open_ = open_ & (F.size(acc["out"]) < rows)
        if total_chars > 0:
            open_ = open_ & (acc["chars"] < total_chars)
        if total_tokens > 0:
            open_ = open_ & (acc["tokens"] < total_tokens)
        return open_

    def within(acc: Column, text: Column) -> Column:
        steps = [
            lambda t: clip(t, chunk_chars) if chunk_chars > 0 else None, lambda t: clip_tokens(t, chunk_tokens) if chunk_tokens > 0 else None,
            lambda t: clip(t, F.lit(total_chars) - acc["chars"], "") if total_chars > 0 else None,
            lambda t: clip_tokens(t, F.lit(total_tokens) - acc["tokens"], "") if total_tokens > 0 else None,
        ]
        own = trim(F.coalesce(text, F.lit("")))
        for step in steps:
            if step(own) is not None:
                own = _bind(own, step)  # each cut sees its input as one value, not as an expression repeated
        return own

    def add(acc: Column, i: Column, text: Column) -> Column:
        more = F.struct(
            F.concat(acc["out"], F.array(F.struct(i.alias("i"), text.alias("text")))).alias("out"), (acc["chars"] + F.length(text)).alias("chars"),
            (acc["tokens"] + token_count(text)).alias("tokens"),
        )
        return F.when(text == "", acc).otherwise(more)

    def step(acc: Column, i: Column) -> Column:
        return F.when(left(acc), _bind(within(acc, F.get(texts, i)), lambda t: add(acc, i, t))).otherwise(acc)

    none = F.struct(F.array().cast("array<struct<i:int,text:string>>").alias("out"), F.lit(0).alias("chars"), F.lit(0).alias("tokens"))
    kept = F.aggregate(F.sequence(F.lit(0), F.size(texts) - 1), none, step, lambda acc: acc["out"])
    return F.when(F.size(texts) > 0, kept).otherwise(F.array().cast("array<struct<i:int,text:string>>"))


def select_context(ranked: DataFrame, rows: int = 10, chunk_chars: int = 1200, total_chars: int = 5000, chunk_tokens: int = 0, total_tokens: int = 0) -> DataFrame:
    """(query, position bigint, source_ref, text): ranked (query, rank, source_ref, text) under the budgets.

    A query's ranked rows are at most the retrieval's k, so they come together in one array and one fold.
    """
    lists = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "source_ref", "text"))).alias("r"))
    lists = lists.withColumn("k", fitting(F.transform("r", lambda x: x["text"]), rows, chunk_chars, total_chars, chunk_tokens, total_tokens))
    kept = lists.select("query", "r", F.posexplode("k").alias("p", "k"))
    return kept.select("query", (F.col("p") + 1).cast("bigint").alias("position"), F.get("r", F.col("k.i"))["source_ref"].alias("source_ref"), F.col("k.text").alias("text"))


def format_context(selected: DataFrame) -> DataFrame:
    """(query, context): numbered blocks with their references."""
    block = F.concat(F.lit("[Context "), F.col("position").cast("string"), F.lit("] ("), F.coalesce("source_ref", F.lit("unknown")), F.lit(")\n"), F.coalesce("text", F.lit("")))
    blocks = selected.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("b"))
    return blocks.select("query", F.array_join(F.transform("b", lambda x: x["b"]), "\n\n").alias("context"))


MODES = ("grounded", "legacy_reasoning")


def prompt_mode(mode: str | None) -> str:
    key = (mode or "").strip().lower().replace("-", "_")
    return key if key in MODES else MODES[0]


def prompt(question: Column, context: Column, history: Column, mode: str = "grounded") -> Column:
    """The prompt of a question; an empty history leaves its part out."""
    rule = {
        "grounded": "Answer from the context alone, name the contexts you used, and say so if they do not hold the answer.",
        "legacy_reasoning": "Think through the context step by step, then answer; say so if the context does not hold the answer.",
    }[prompt_mode(mode)]
    past = trim(F.coalesce(history, F.lit("")))
    talk = F.when(past == "", "").otherwise(F.concat(F.lit("Conversation so far:\n"), past, F.lit("\n\n")))
    return F.concat(F.lit(rule + "\n\n"), talk, F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))
