"""Sparse lexical vectors. Everything about one text is decided in its row, so vectors cost no shuffle."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import lexical_terms


def term_id(term: Column) -> Column:
    """A stable unsigned 32-bit id of a term: the first four bytes of its MD5."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")


def blake2b_id(term: Column) -> Column:
    """The unsigned 32-bit id by BLAKE2b of four bytes, big-endian, as vectors made elsewhere may have it; a Python function, as Spark has no such hash."""
    @F.pandas_udf("bigint")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big"))

    return run(term)


def _bind(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def term_counts(terms: Column) -> Column:
    """array<struct<term, tf>> of an array of terms: sorted once, then a term's count is the distance to the next one."""

    def runs(s: Column) -> Column:
        begin = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        lengths = lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).alias("tf")))
        return F.when(F.size(s) > 0, _bind(begin, lengths)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))

    return _bind(F.array_sort(terms), runs)


def term_vector(text: Column, most: int = 512, least: int = 2) -> Column:
    """array<struct<term, term_id, weight>>: 1 + ln(tf) of a text's ``most`` most frequent terms, ties by id; most <= 0 keeps all."""
    ranked = F.transform(term_counts(lexical_terms(text, least)), lambda x: F.struct((-x["tf"]).alias("order"), term_id(x["term"]).alias("term_id"), x["term"].alias("term")))
    kept = _bind(ranked, lambda r: F.when(F.size(r) > most, F.slice(F.array_sort(r), 1, most)).otherwise(r)) if most > 0 else ranked
    return F.transform(kept, lambda x: F.struct(x["term"], x["term_id"], (F.lit(1.0) + F.log((-x["order"]).cast("double"))).alias("weight")))


def vector_lists(docs: DataFrame, key: str, text: str, most: int = 512, least: int = 2) -> DataFrame:
    """(key, v): the vector of each row; ``key`` is one row's."""
    return docs.select(key, term_vector(F.col(text), most, least).alias("v"))


def term_vectors(docs: DataFrame, key: str, text: str, most: int = 512, least: int = 2) -> DataFrame:
    """(key, term, term_id, weight): the vectors, a row for each term."""
    return vector_lists(docs, key, text, most, least).select(key, F.explode("v").alias("x")).select(key, "x.term", "x.term_id", "x.weight")


def indexed(vector: Column) -> Column:
    """struct<indices, values> of a vector, sorted by term id, as an index stores it."""
    pairs = F.array_sort(F.transform(vector, lambda x: F.struct(x["term_id"].alias("i"), x["weight"].alias("w"))))
    return _bind(pairs, lambda p: F.struct(F.transform(p, lambda x: x["i"]).alias("indices"), F.transform(p, lambda x: x["w"]).alias("values")))


def sparse_vectors(docs: DataFrame, key: str, text: str, most: int = 512) -> DataFrame:
    """(key, indices, values), sorted by term id; texts without terms are left out."""
    rows = vector_lists(docs, key, text, most).where(F.size("v") > 0)
    return rows.select(key, indexed(F.col("v")).alias("s")).select(key, "s.indices", "s.values")


def numbered(vector: Column) -> Column:
    """array<struct<term, weight>> of a vector, a term by its 64-bit hash: for searches, which need no more; about half the size on disk."""
    return F.transform(vector, lambda x: F.struct(F.xxhash64(x["term"]).alias("term"), x["weight"].alias("weight")))


def doc_frequency(lists: DataFrame, vector: str = "v") -> DataFrame:
    """(term, df): a vector holds a term once, so a count is enough; combined before its shuffle."""
    return lists.select(F.explode(F.transform(vector, lambda x: x["term"])).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))
