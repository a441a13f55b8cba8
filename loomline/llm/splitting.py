"""Problem 7: cutting oversized items into balanced pieces at natural boundaries.

The least number of pieces follows from length, limit and overlap. Equal targets are placed, and every cut snaps to the
strongest boundary near its target: paragraph, line, sentence, clause, word; inside a long word any place that parts no
combined character. A piece's start is its predecessor's end less the overlap, snapped to a boundary as well. If a
piece breaks the limit, one more piece is planned. Only offsets leave the Python worker; texts are cut by the JVM.

Results by case: null and empty texts and texts within the limit give no pieces (``keep_small``: one whole piece);
lengths are Unicode code points; repeated rows count once; limits without overlap (null) overlap by 0.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries by strength, strongest first; a cut goes to the end of a match.
BOUNDARIES = tuple(
    re.compile(p) for p in (r"\n[ \t\r]*\n\s*", r"\r?\n", r"[.!?…。！？][\"')\]”’»]*\s+", r"[;:,，；：]\s+", r"\s+")
)


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part one visible character."""
    if not 0 < at < len(text):
        return False
    after, before = text[at], text[at - 1]
    return (
        unicodedata.combining(after) != 0
        or after in "‍️︎"
        or before == "‍"
        or (before == "\r" and after == "\n")
        or 0x1F3FB <= ord(after) <= 0x1F3FF
    )


def _snap(text: str, target: int, low: int, high: int) -> int:
    """The place in [low, high] of the strongest boundary, the nearest to ``target`` among equals."""
    low, high = max(low, 1), min(high, len(text))
    if low >= high:
        return max(min(target, high), 0)
    for pattern in BOUNDARIES:
        best = None
        for m in pattern.finditer(text, max(low - 3, 0), high):
            if low <= m.end() <= high and (best is None or abs(m.end() - target) < abs(best - target)):
                best = m.end()
        if best is not None:
            return best
    at = min(max(target, low), high)
    while at > low and _joined(text, at):
        at -= 1
    return at


def _plan(text: str, limit: int, overlap: int, pieces: int) -> list[tuple[int, int]] | None:
    size = len(text)
    step = (size - overlap) / pieces
    slack = max(int(min(step, limit) * 0.2), 1)
    out, start = [], 0
    for i in range(1, pieces + 1):
        if i == pieces:
            end = size
        else:
            target = int(round(overlap + i * step))
            end = _snap(text, min(target, start + limit), max(target - slack, start + overlap + 1), min(target + slack, start + limit))
        if not start < end or end - start > limit:
            return None
        out.append((start, end))
        if i < pieces:
            wide = max(min(overlap // 2, slack), 0)
            nxt = _snap(text, end - overlap, max(end - overlap - wide, start + 1), min(end - overlap + wide, end)) if overlap else end
            start = min(max(nxt, start + 1), end)
    return out


def cut_offsets(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text: all of it covered, each within ``limit``."""
    size = len(text)
    if size <= limit:
        return [(0, size)]
    overlap = max(0, min(overlap, limit - 1))
    pieces = max(2, math.ceil((size - overlap) / (limit - overlap)))
    bound = pieces * 2 + 8
    while pieces <= bound:
        if plan := _plan(text, limit, overlap, pieces):
            return plan
        pieces += max(1, pieces // 50)
    out, start = [], 0
    while True:  # boundaries too far apart for any balanced plan: cut at the limit
        end = min(start + limit, size)
        while end < size and end > start + 1 and _joined(text, end):
            end -= 1
        out.append((start, end))
        if end == size:
            return out
        start = max(end - overlap, start + 1)


def _offsets_udf(limit: int, overlap: int):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def offsets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in cut_offsets(t, limit, overlap)])

    return offsets


def split_oversized(
    items: DataFrame, id_col: str, limit: int, overlap: int | None, text_col: str = "text", keep_small: bool = False
) -> DataFrame:
    """(record_id, piece_no bigint, start int, end int, text) of the pieces of every text longer than ``limit``."""
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = items.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("whole")).where("whole is not null and whole <> ''")
    over = rows.where(F.length("whole") > limit).distinct()
    cut = over.withColumn("at", _offsets_udf(limit, overlap or 0)(F.col("whole")))
    if keep_small:
        whole = rows.where(F.length("whole") <= limit).distinct()
        cut = cut.unionByName(whole.withColumn("at", F.array(F.struct(F.lit(0).alias("start"), F.length("whole").alias("end")))))
    return cut.select("record_id", "whole", F.posexplode("at").alias("piece_no", "at")).select(
        "record_id", F.col("piece_no").cast("bigint").alias("piece_no"), "at.start", "at.end",
        F.expr("substring(whole, at.start + 1, at.end - at.start)").alias("text"),
    )


def split_tables(documents: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of both kinds of record, with ``record_kind`` first; of several limits of a kind the strictest size and the greatest overlap count."""
    rows = limits.where(F.col("record_kind").isin("document", "chunk")).groupBy("record_kind").agg(F.min("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    by_kind = {r["record_kind"]: r for r in rows.collect()}  # at most one row for each kind
    parts = []
    for kind, table, key in (("document", documents, "doc_id"), ("chunk", chunks, "chunk_id")):
        if (r := by_kind.get(kind)) and r["max_chars"]:
            parts.append(split_oversized(table, key, r["max_chars"], r["overlap_chars"]).select(F.lit(kind).alias("record_kind"), "*"))
    if not parts:
        raise ValueError("size_limits names neither document nor chunk")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def found_oversized(documents: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """p7_found: (record_kind, record_id) of the records that came out in more than one piece."""
    return split_tables(documents, chunks, limits).where("piece_no = 1").select("record_kind", "record_id").distinct()
