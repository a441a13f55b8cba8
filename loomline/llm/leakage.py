"""Problem 9: passages of evaluation items inside a corpus.

A distributed positional inverted index, stored once: every block of documents gives, for each of its terms, a posting
row with the documents and positions of all occurrences; so the index is partitioned by documents, is made without a
shuffle, and no row grows beyond its block. Exact phrase queries start from the rarest terms: a document holds ``least``
consecutive words of a passage only if it holds one of the passage's windows, with all its words at one offset. So the
postings of each window's rarest words (by counts over all documents) are intersected after adjustment by their place in
the passage: the offset must be the same for all ANCHORS of them. What agrees, a small set, is then compared word by word
with the passage at that offset, and the longest run of equal words is reported. Proximity matches (``slack`` > 0) allow
the offsets to differ: at least ``share`` of ``least`` consecutive words of the passage stand within ``slack`` words of
their place. Terms are 64-bit hashes in the index; texts decide.

Results by case: null and blank texts and passages hold nothing; passages of fewer than ``least`` words match nothing;
white space, line breaks and punctuation between words do not matter; repeated rows count once; an id on two texts
counts if either holds the passage.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.words import words
from loomline.session import Stage, staging

#: A side is broadcast up to this many rows of a few bytes each, counted before.
BROADCAST_ROWS = 200_000
#: So many of the rarest words of a window must agree on the offset before texts are read.
ANCHORS = 3
#: Words of a block of the index; a longer document is a block of its own.
BLOCK_WORDS = 1_000_000


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _postings(block: int):
    def run(batches):
        for batch in batches:
            edges = batch.column("h").offsets.to_numpy().astype(np.int64)
            terms = batch.column("h").values.to_numpy()[edges[0] : edges[-1]]
            edges -= edges[0]
            a = 0
            while a < len(edges) - 1:
                b = max(a + 1, int(np.searchsorted(edges, edges[a] + block, side="right")) - 1)
                part, sizes = terms[edges[a] : edges[b]], np.diff(edges[a : b + 1])
                row = np.repeat(np.arange(a, b), sizes)
                place = np.arange(len(part)) - np.repeat(edges[a:b] - edges[a], sizes)
                order = np.argsort(part, kind="stable")
                part, row, place = part[order], row[order], place[order]
                new = np.append(True, part[1:] != part[:-1])[: len(part)]
                begin = np.flatnonzero(new)
                met = np.append(True, row[1:] != row[:-1])[: len(part)] | new
                cuts = pa.array(np.append(begin, len(part)).astype(np.int32))
                df = np.add.reduceat(met.astype(np.int32), begin) if len(begin) else np.zeros(0, dtype=np.int32)
                docs = pa.ListArray.from_arrays(cuts, batch.column("doc").take(pa.array(row)))
                places = pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(df.astype(np.int32)), docs, places], names=["term", "df", "docs", "places"])
                a = b

    return run


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_WORDS) -> DataFrame:
    """(term, df, docs, places): by block and term the documents that hold it and every occurrence (docs[i] at places[i]).

    Write it once and pass it to ``find_leaks``; term is the xxhash64 of the word, df counts the block's documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("h")).where("size(h) > 0")
    return rows.mapInArrow(_postings(block), f"term long, df int, docs array<{kind}>, places array<int>")


def _best_window(hits, least: int):
    """The greatest number of true values in ``least`` neighbours of an array of booleans."""
    ones = F.transform(hits, lambda h: h.cast("int"))
    bound = F.transform(F.array(ones), lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - least + 1, F.lit(1))), lambda i: F.aggregate(F.slice(x, i, F.lit(least)), F.lit(0), lambda s, v: s + v)))
    return F.array_max(bound[0])


def _passage_terms(items: DataFrame, item_col: str, passage_col: str) -> DataFrame:
    """(query_id, passage, q_pos, word, term) of the distinct passages."""
    split = items.select(F.col(item_col).alias("query_id"), words(F.col(passage_col)).alias("w")).distinct()
    return split.select("query_id", F.xxhash64("w").alias("passage"), F.posexplode("w").alias("q_pos", "word")).withColumn("term", F.xxhash64("word"))


def _agreeing(index: DataFrame, terms: DataFrame, least: int, slack: int, share: float) -> DataFrame:
    """(doc, query_id, passage, shift, to): places where the rarest words of a window stand as in the passage, or within ``slack``."""
    asked = terms.count()
    known = _maybe_broadcast(terms.select("term").distinct(), asked)
    counts = index.select("term", "df").join(known, "term").groupBy("term").agg(F.sum("df").alias("df"))
    ranked = terms.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    spare = least - math.ceil(share * least) if slack else 0  # so many words of a window may be absent from a proximity match
    frame = Window.partitionBy("query_id", "passage").orderBy("q_pos").rowsBetween(0, least - 1)
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("df", "term", "q_pos")).over(frame)), 1, min(ANCHORS + spare, least))
    windows = ranked.select("query_id", "passage", rarest.alias("rarest"), F.count("*").over(frame).alias("full"), F.min("df").over(frame).alias("fewest"))
    windows = windows.where(F.col("full") == least)
    windows = windows.where("fewest > 0") if not slack else windows
    anchors = windows.select("query_id", "passage", F.explode("rarest").alias("r")).where("r.df > 0").select("query_id", "passage", "r.term", "r.q_pos")
    anchors = Stage(anchors.distinct(), "anchors").df
    n = anchors.count()
    rows = index.select("term", "docs", "places").join(_maybe_broadcast(anchors.select("term").distinct(), n), "term")
    postings = rows.select("term", F.explode(F.arrays_zip("docs", "places")).alias("o")).select("term", F.col("o.docs").alias("doc"), F.col("o.places").alias("pos"))
    hits = postings.join(_maybe_broadcast(anchors, n), "term").select("doc", "query_id", "passage", "q_pos", (F.col("pos") - F.col("q_pos")).alias("shift"))
    need = min(ANCHORS, least)
    keys = ["doc", "query_id", "passage"]
    if slack:  # two grids of cells, so that offsets that differ by at most ``slack`` meet in a cell of one of them
        cell = F.explode(F.array(F.floor(F.col("shift") / (2 * slack)) * 2, F.floor((F.col("shift") + slack) / (2 * slack)) * 2 + 1))
        cells = hits.withColumn("cell", cell).groupBy(*keys, "cell").agg(F.countDistinct("q_pos").alias("agree"), F.min("shift").alias("shift"), F.max("shift").alias("to"))
        agreed = cells.where(F.col("agree") >= need).select(*keys, "shift", "to")
        agreed = agreed.union(hits.groupBy(*keys, "shift").agg(F.count("*").alias("agree")).where(F.col("agree") >= need).select(*keys, "shift", F.col("shift").alias("to"))).distinct()
    else:
        agreed = hits.groupBy(*keys, "shift").agg(F.count("*").alias("agree")).where(F.col("agree") >= need).select(*keys, "shift", F.col("shift").alias("to"))
    return agreed


def find_leaks(
    docs: DataFrame, items: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", item_col: str = "query_id",
    passage_col: str = "gold_passage", slack: int = 0, share: float = 0.75, index: DataFrame | None = None,
) -> DataFrame:
    """(id_col, item_col, run bigint, near bigint): documents with at least ``least`` consecutive words of a passage, longest run.

    With ``slack`` also proximity matches (run < least): near of ``least`` consecutive words of the passage, at least
    ``share`` of them. ``index``: a stored ``positional_index`` of the same documents; without one it is made here.
    """
    with staging() as stages:
        terms = stages.keep(Stage(_passage_terms(items, item_col, passage_col), "terms"))
        index = Stage(positional_index(docs, id_col, text_col), "postings").df if index is None else index
        agreed = stages.keep(Stage(_agreeing(index, terms, least, slack, share), "agreed"))
    asked = terms.count()
    named = Stage(agreed.select("doc").distinct(), "named").df
    whole = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(_maybe_broadcast(named, named.count()), "doc", "left_semi")
    split = whole.distinct().select("doc", words(F.col("text")).alias("w"))
    passages = terms.groupBy("query_id", "passage").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("q_pos", "word"))), lambda s: s["word"]).alias("p")
    )
    both = split.join(agreed, "doc").join(_maybe_broadcast(passages, asked), ["query_id", "passage"])
    run = F.aggregate(
        F.transform(F.col("p"), lambda t, i: F.coalesce(t == F.get(F.col("w"), F.col("shift") + i), F.lit(False))),
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, hit: F.when(
            hit, F.struct((a["run"] + 1).alias("run"), F.greatest(a["best"], a["run"] + 1).alias("best"))
        ).otherwise(F.struct(F.lit(0).alias("run"), a["best"].alias("best"))),
        lambda a: a["best"],
    )
    if slack:
        low = lambda i: F.greatest(F.col("shift") - slack + i + 1, F.lit(1))
        high = lambda i: F.col("to") + slack + i + 2
        about = F.transform("p", lambda t, i: F.coalesce(F.array_contains(F.slice("w", low(i), F.greatest(high(i) - low(i), F.lit(0))), t), F.lit(False)))
        near = F.least(_best_window(about, least), F.lit(least))
    else:
        near = F.least(run, F.lit(least))
    found = both.select("doc", "query_id", run.alias("run"), near.alias("near"))
    longest = found.groupBy("doc", "query_id").agg(F.max("run").cast("bigint").alias("run"), F.max("near").cast("bigint").alias("near"))
    enough = (F.col("run") >= least) | (F.col("near") >= math.ceil(share * least)) if slack else F.col("run") >= least
    return longest.where(enough).withColumnsRenamed({"doc": id_col, "query_id": item_col})
