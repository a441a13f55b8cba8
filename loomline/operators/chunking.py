"""Chunking: routing, character windows, paragraph packing.

Packing is arithmetic on lengths: a fold inside the JVM decides where groups begin, the texts are sliced and joined once.
Only sentences (of oversized paragraphs) and windows, which look at single characters, are made by Arrow UDFs. Null and
blank texts give no chunks.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import ABBREVIATIONS, collapse, paragraphs, stable_id, trim
from loomline.functions.values import overlay

_CLOSERS = "\"')]}"
_OPENERS = "\"'([{"
_STOP = re.compile(r"[.!?][\"')\]}]*")
_KNOWN, _INITIALS = frozenset(ABBREVIATIONS), re.compile(r"(?:[A-Za-z]\.){2,}")


def sentences_of(text: str) -> list[str]:
    """Sentences: a stop ends one if what follows begins in upper case, a digit, a quote or a bracket, unless the word before is an abbreviation."""
    flat = " ".join(text.split())
    out, start = [], 0
    for stop in _STOP.finditer(flat):
        if stop.start() < start:
            continue
        head = flat[start : stop.end()].strip()
        rest = flat[stop.end() :].lstrip()
        if not head or not rest:
            continue
        word = head.rsplit(None, 1)[-1].rstrip(_CLOSERS)
        if word.lower() in _KNOWN or _INITIALS.fullmatch(word):
            continue
        if rest[0].isupper() or rest[0].isdigit() or rest[0] in _OPENERS:
            out.append(head)
            start = len(flat) - len(rest)
    tail = flat[start:].strip()
    return [*out, tail] if tail else out


def window_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of overlapping windows of a trimmed text; progress is always made.

    A window ends at its last line break, else its last space, if that lies beyond the first third.
    """
    marks = {c: [m.start() for m in re.finditer(c, text)] for c in ("\n", " ")}

    def last(c: str, low: int, high: int) -> int:
        at = bisect.bisect_left(marks[c], high) - 1
        return marks[c][at] if at >= 0 and marks[c][at] >= low else -1

    bounds = [(0, 0)]
    while bounds[-1][1] < len(text):
        low = max(bounds[-1][0] + 1, bounds[-1][1] - overlap) if len(bounds) > 1 else 0
        high = low + size
        if high < len(text):
            cut = max(last("\n", low, high), -1)
            cut = last(" ", low, high) if cut < 0 else cut
            high = cut if cut - low > size // 3 else high
        bounds.append((low, min(high, len(text))))
    return bounds[1:]


def sentence_array(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentences_of(t) if isinstance(t, str) else [])

    return split(text)


def _bind(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def group_starts(lengths: Column, most: int, glue: int, breaks: Column | None = None) -> Column:
    """The places in ``lengths`` where a group begins, if neighbours are joined by ``glue`` characters as long as they stay
    within ``most`` (<= 0: no limit); a true value in ``breaks`` begins a group as well."""

    def step(acc: Column, i: Column) -> Column:
        own = F.get(lengths, i)
        longer = acc["run"] + glue + own
        new = F.coalesce(F.get(breaks, i), F.lit(False)) if breaks is not None else F.lit(False)
        new = (i > 0) & (new | (longer > most)) if most > 0 else (i > 0) & new
        return F.struct(
            F.when(new, F.concat(acc["at"], F.array(i))).otherwise(acc["at"]).alias("at"), F.when(new | (i == 0), own).otherwise(longer).alias("run")
        )

    start = F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).alias("run"))
    found = F.aggregate(F.sequence(F.lit(0), F.size(lengths) - 1), start, step, lambda acc: acc["at"])
    return F.when(F.size(lengths) > 0, found).otherwise(F.array().cast("array<int>"))


def ranges_of(starts: Column, total: Column) -> Column:
    """array<struct<a, b>>: from each start up to the next, the last up to ``total``."""
    return F.transform(starts, lambda at, k: F.struct(at.alias("a"), F.coalesce(F.get(starts, k + 1), total).alias("b")))


def joined(texts: Column, span: Column, glue: str) -> Column:
    return F.array_join(F.slice(texts, span["a"] + 1, span["b"] - span["a"]), glue)


def grouped(texts: Column, most: int, glue: str = " ") -> Column:
    """Neighbouring texts joined as long as they stay within ``most``; most <= 0 joins all."""
    spans = lambda t: ranges_of(group_starts(F.transform(t, lambda x: F.length(x)), most, len(glue)), F.size(t))
    return _bind(texts, lambda t: F.filter(F.transform(spans(t), lambda s: F.trim(joined(t, s, glue))), lambda x: x != ""))


def divided(texts: Column, target: int) -> Column:
    """array<struct<text, parts>>: texts longer than ``target`` as groups of their sentences; parts is 1 for whole texts."""

    @F.pandas_udf("array<array<string>>")
    def sentences(units: pd.Series) -> pd.Series:
        return units.map(lambda u: None if u is None else [sentences_of(t) if len(t) > target else [] for t in u])

    whole = lambda t: F.array(F.struct(t.alias("text"), F.lit(1).alias("parts")))
    if target <= 0:
        return F.flatten(F.transform(texts, whole))
    over = F.exists(texts, lambda t: F.length(t) > target)
    cut = sentences(F.when(over, texts))
    split = lambda t, parts: F.when(F.size(parts) > 1, _bind(grouped(parts, target), lambda g: F.transform(g, lambda x: F.struct(x.alias("text"), F.size(g).alias("parts"))))).otherwise(whole(t))
    many = F.flatten(F.transform(F.arrays_zip(texts.alias("t"), cut.alias("s")), lambda z: split(z["t"], z["s"])))
    return F.when(over, many).otherwise(F.flatten(F.transform(texts, whole)))


def kept_starts(spans: Column, size_of, least: int, same=None) -> Column:
    """The places among ``spans`` where a chunk begins: a span shorter than ``least`` joins its predecessor (if ``same`` of both)."""
    small = lambda k: size_of(F.get(spans, k)) < least
    joins = (lambda k: small(k) & same(F.get(spans, k - 1), F.get(spans, k))) if same else small
    return F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: (k == 0) | ~joins(k))


def packed_array(parts: Column, target: int, least: int) -> Column:
    """Paragraphs packed up to ``target``; oversized ones fall apart into sentence groups; a small rest joins its predecessor."""
    if least < 0:
        raise ValueError("least must not be negative")

    def pack(units: Column) -> Column:
        spans = ranges_of(group_starts(F.transform(units, lambda u: F.length(u)), target, 2), F.size(units))
        return _bind(spans, lambda s: chunks(units, s))

    def chunks(units: Column, spans: Column) -> Column:
        starts = kept_starts(spans, lambda s: F.length(joined(units, s, "\n\n")), least)
        whole = ranges_of(F.transform(starts, lambda k: F.get(spans, k)["a"]), F.size(units))
        return F.transform(whole, lambda s: joined(units, s, "\n\n"))

    texts = F.transform(divided(parts, target), lambda p: p["text"])
    return F.when(F.size(parts) > 0, _bind(texts, pack)).otherwise(F.array().cast("array<string>"))


def window_array(text: Column, size: int, overlap: int) -> Column:
    """The windows of a text, trimmed, empty ones left out."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need 0 <= overlap < size")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        flat = texts.map(lambda t: t.strip() if isinstance(t, str) else "")
        return flat.map(lambda t: [w for a, b in window_bounds(t, size, overlap) if (w := t[a:b].strip())])

    return run(text)


def route(docs: DataFrame) -> DataFrame:
    """Adds ``route``: thread (a chat thread stays whole), section (cut already), paragraphs (other PDF), windows."""
    kind, meta = F.lower(trim(F.coalesce("source_type", F.lit("")))), F.col("metadata")
    single = (kind == "webex") & meta["thread_id"].isNotNull() & (F.coalesce(meta["message_count"].try_cast("int"), F.lit(0)) > 1)
    cut = (kind == "pdf") & F.coalesce(meta["split_mode"].isin("chapter_paragraph", "page_paragraph", "page_fallback"), F.lit(False))
    return docs.withColumn("route", F.when(F.coalesce(single, F.lit(False)), "thread").when(cut, "section").when(kind == "pdf", "paragraphs").otherwise("windows"))


def thread_text(metadata: Column, text: Column) -> Column:
    """A thread's text, preceded by its first line where that is missing."""
    root, body = F.coalesce(trim(metadata["thread_start_line"]), F.lit("")), trim(text)
    return F.when((root == "") | body.startswith(root), body).otherwise(F.concat(root, F.lit("\n"), body))


def chunk_documents(docs: DataFrame, size: int = 1100, overlap: int = 180, least: int = 160) -> DataFrame:
    """(chunk_id, doc_id, source_type, source_ref, text, metadata, chunk_index) of all documents, each by its route.

    Windows shorter than ``least`` are dropped, the indexes of the others kept.
    """
    routed = route(docs).where(trim(F.coalesce("text", F.lit(""))) != "")
    whole = F.array(thread_text(F.col("metadata"), F.col("text")))
    parts = [
        routed.where(F.col("route").isin("thread", "section")).withColumn("parts", F.when(F.col("route") == "thread", whole).otherwise(F.array(trim(F.col("text"))))),
        routed.where("route = 'paragraphs'").withColumn("parts", packed_array(paragraphs(F.col("text")), size, least)),
        routed.where("route = 'windows'").withColumn("parts", window_array(collapse(F.col("text")), size, overlap)),
    ]
    all_parts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    flat = all_parts.select("*", F.posexplode("parts").alias("chunk_index", "chunk_text"))
    flat = flat.where((F.col("route") != "windows") | (F.length("chunk_text") >= least))
    own = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("title"), F.col("title"), F.lit("page"), F.col("page").cast("string"), F.lit("created_at"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return flat.select(
        stable_id(F.col("doc_id"), F.col("chunk_index"), F.substring("chunk_text", 1, 120)).alias("chunk_id"), "doc_id", "source_type", "source_ref",
        F.col("chunk_text").alias("text"), overlay(F.map_filter(own, lambda _, v: v.isNotNull()), F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("metadata"),
        "chunk_index", "route",
    )
