"""Answer candidates: relevance, support by the context, blend, best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import distinct_texts
from loomline.models import Generator, generate
from loomline.plans.retrieve import blend


def candidates(prompts: DataFrame, model: Generator, n: int) -> DataFrame:
    """(query, position, answer): up to n different answers out of max(2n, n + 2) attempts."""
    tries = [generate(F.col("prompt"), model, seed) for seed in range(max(2 * n, n + 2))]
    texts = F.slice(distinct_texts(F.array_compact(F.array(*tries))), 1, n)
    return prompts.select("query", F.posexplode(texts).alias("position", "answer"))


def support(scored: DataFrame, top: int = 3) -> DataFrame:
    """(query, position, support): the best of a candidate's scores against the first ``top`` contexts that are not blank.

    scored: (query, position, context_no, context, score). Candidates without contexts have support 0.
    """
    near = F.when((F.col("context_no") <= top) & (F.trim(F.coalesce("context", F.lit(""))) != ""), F.col("score"))
    return scored.groupBy("query", "position").agg(F.coalesce(F.max(near), F.lit(0.0)).alias("support"))


def rank_answers(rows: DataFrame, alpha: float = 0.7, mode: str = "cross_encoder") -> DataFrame:
    """rows (query, position, relevance, support) with score and rank. One candidate or mode none: zeros in input order."""
    alone = F.count("*").over(Window.partitionBy("query")) <= 1
    off = F.lit(mode == "none") | alone
    zero = lambda c: F.when(off, 0.0).otherwise(c)
    scored = rows.withColumn("score", zero(F.round(blend(F.col("relevance"), F.col("support"), alpha), 6)))
    scored = scored.withColumns({"relevance": zero(F.col("relevance")), "support": zero(F.col("support"))})
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "position")))


def best_answers(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """(query, answer) of the greatest score, ties by position; a combining aggregate."""
    return rows.groupBy("query").agg(F.max_by(answer, F.struct("score", -F.col("position"))).alias(answer))


def no_candidates(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)) == 0
