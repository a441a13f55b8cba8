"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import abstains, blank_to_null, distinct_texts, phrase_hits


def load_cases(raw: DataFrame, pos: str | None = None) -> DataFrame:
    """Cases with cleaned label sets; a blank question is an error; a missing id is case-{position}."""
    bad = F.raise_error(F.lit("case without question"))
    ids = blank_to_null(F.col("query_id"))
    ids = F.coalesce(ids, F.concat(F.lit("case-"), F.col(pos).cast("string"))) if pos else ids
    clean = lambda c: F.coalesce(distinct_texts(F.col(c)), F.array().cast("array<string>"))
    return raw.select(
        ids.alias("query"), F.coalesce(blank_to_null(F.col("question")), bad).alias("question"), clean("expected_source_refs").alias("refs"), clean("expected_chunk_ids").alias("chunks"),
        clean("expected_answer_contains").alias("phrases"), "answerable",
    ).distinct()


def labelled(cases: DataFrame) -> Column:
    return (F.size(cases["refs"]) > 0) | (F.size(cases["chunks"]) > 0)


def matches(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """(query, rank) of retrieved rows (query, rank, source_ref, chunk_id, linked_chunk_id) that a case expects."""
    met = rows.join(cases.select("query", "refs", "chunks"), "query")
    hit = F.array_contains("refs", F.col("source_ref")) | F.array_contains("chunks", F.col("chunk_id")) | F.array_contains("chunks", F.col("linked_chunk_id"))
    return met.where(F.coalesce(hit, F.lit(False))).select("query", "rank")


def best_ranks(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """(query, best_rank) of all labelled cases; null without a match."""
    best = matches(rows, cases).groupBy("query").agg(F.min("rank").alias("best_rank"))
    return cases.where(labelled(cases)).select("query").join(best, "query", "left")


def case_reports(rows: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """(query, question, match_rank, hit_at_k, top_rows) of every case: its k first rows (query, rank, source_ref, chunk_id, record_type, score, ...) and where it was met."""
    fields = [F.col(c) for c in ("rank", "source_ref", "chunk_id", "record_type") if c in rows.columns]
    numbers = [F.col(c).cast("double").alias(c) for c in ("first_score", "rerank_score", "recency_bonus") if c in rows.columns]
    row = F.struct(*fields, F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), *numbers)
    tops = rows.where(F.col("rank") <= k).groupBy("query").agg(F.array_sort(F.collect_list(row)).alias("top_rows"))
    best = best_ranks(rows, cases).withColumnRenamed("best_rank", "match_rank")
    out = cases.select("query", "question").join(best, "query", "left").join(tops, "query", "left")
    return out.select("query", "question", "match_rank", F.coalesce(F.col("match_rank") <= k, F.lit(False)).alias("hit_at_k"), F.coalesce("top_rows", F.array().cast(tops.schema["top_rows"].dataType)).alias("top_rows"))


def recall_mrr(best: DataFrame, k: int) -> DataFrame:
    """(labelled, recall, mrr); null rates if there is no labelled case."""
    hit = F.col("best_rank").isNotNull() & (F.col("best_rank") <= k)
    return best.agg(
        F.count("*").alias("labelled"), F.round(F.avg(hit.cast("double")), 6).alias("recall"), F.round(F.avg(F.when(hit, 1.0 / F.col("best_rank")).otherwise(0.0)), 6).alias("mrr")
    )


def answer_report(answers: DataFrame) -> DataFrame:
    """answers (query, answer, phrases, answerable, seconds): abstain rates by answerable, share of full phrase hits, mean time."""
    out, hits = abstains(F.col("answer")), phrase_hits(F.col("answer"), F.col("phrases"))
    rows = answers.withColumns({"_abstain": out.cast("double"), "_all": F.when(F.size("phrases") > 0, (F.size(hits) == F.size("phrases")).cast("double"))})
    rate = lambda cond: F.round(F.avg(F.when(cond, F.col("_abstain"))), 6)
    return rows.agg(
        F.count("*").alias("cases"), rate(F.col("answerable")).alias("abstain_answerable"), rate(~F.col("answerable")).alias("abstain_unanswerable"), rate(F.col("answerable").isNull()).alias("abstain_unlabelled"),
        F.round(F.avg("_all"), 6).alias("phrase_full_hit"), F.round(F.avg("seconds"), 6).alias("mean_seconds"),
    )


def token_f1(pairs: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """(key, f1): F1 over words with their counts; 0 if either side has none."""
    tokens = lambda c: F.transform(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"[A-Za-z0-9']+"), F.lit(0)), lambda w: F.lower(w))
    both = pairs.select(key, tokens(pred).alias("p"), tokens(gold).alias("g"))
    each = both.select(key, F.explode("p").alias("w"), F.lit(1).alias("np"), F.lit(0).alias("ng")).unionByName(both.select(key, F.explode("g").alias("w"), F.lit(0).alias("np"), F.lit(1).alias("ng")))
    common = each.groupBy(key, "w").agg(F.sum("np").alias("np"), F.sum("ng").alias("ng")).groupBy(key).agg(F.sum(F.least("np", "ng")).alias("c"))
    sizes = both.select(key, F.size("p").alias("np"), F.size("g").alias("ng")).join(common, key, "left")
    return sizes.select(key, F.when((F.col("np") == 0) | (F.col("ng") == 0), 0.0).otherwise(F.round(2.0 * F.coalesce("c", F.lit(0)) / (F.col("np") + F.col("ng")), 6)).alias("f1"))
