"""Problem 8: token ids of a whole corpus by a public byte-level BPE.

Everything stays in Spark expressions. A text is cut into pieces by the tokenizer's pattern. The rank file (a fixed
vocabulary) enters the plan as a literal: an array of small maps, addressed by the CRC of the bytes, so a look-up
touches a handful of entries. Pieces that are tokens themselves are looked up; each other distinct piece of the corpus
is folded once, by ``aggregate`` over its byte array, always merging the pair of lowest rank.

The folded pieces are a dictionary of the corpus. The ``literal_words`` of them that most texts hold are added to the
literal map; if it holds all, texts are encoded in one projection without a shuffle. Pieces beyond those stay a table:
texts ask for their rare ones by a shuffled join and meet the answers, long texts in blocks.

Results by case: null, empty text: empty list. One row per distinct id; a repeated id takes its smallest text (tables
whose ids are unique by contract skip that grouping with ``unique_ids``).
"""

from __future__ import annotations

import base64
import json
import os
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.skew import hub_join
from loomline.session import Stage

TOKENIZERS = os.environ.get("LOOMLINE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges, with Unicode white space spelled out for Java.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
NONE = 2**31 - 1
#: Pieces with more bytes are merged by the tokenizer library's heap, as the fold copies its arrays at every merge.
FOLD_BYTES = 10_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Lookup:
    """A dictionary as one constant of the plan: an array of small maps, addressed by the CRC of the key."""

    def __init__(self, entries: dict[str, object], kind: str = "int"):
        self.buckets = max(16, 1 << max(0, len(entries) // 4).bit_length())
        parts: list[dict[str, object]] = [{} for _ in range(self.buckets)]
        for key, value in entries.items():
            parts[zlib.crc32(key.encode()) % self.buckets][key] = value
        self.literal = F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), f"array<map<string,{kind}>>")

    def __call__(self, key: Column) -> Column:
        """The value of a key, null if there is none."""
        return F.try_element_at(F.get(self.literal, (F.crc32(key.cast("binary")) % self.buckets).cast("int")), key)


def rank_literal(ranks: dict[bytes, int]) -> Lookup:
    """Ranks by byte string; byte strings are written in Latin-1, one character a byte."""
    return Lookup({token.decode("latin-1"): rank for token, rank in ranks.items()})


def word_literal(ranks: dict[bytes, int], folded: dict[str, list[int]] | None = None) -> Lookup:
    """Ids by piece: tokens that are whole pieces and, if given, folded pieces."""
    entries: dict[str, list[int]] = dict(folded or {})
    for token, rank in ranks.items():
        try:
            entries[token.decode()] = [rank]
        except UnicodeDecodeError:
            pass
    return Lookup(entries, "array<int>")


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def fold_merges(literal: Lookup, data: Column) -> Column:
    """Ids of a byte string of at least one byte: adjacent parts of the lowest rank merge until none can.

    The ranks of neighbours are kept beside the parts, so a merge looks up two new ranks only.
    """
    rank = lambda x: F.coalesce(literal(x), F.lit(NONE))
    state = lambda parts, ranks: F.struct(parts.alias("parts"), ranks.alias("ranks"), F.coalesce(F.array_min(ranks), F.lit(NONE)).alias("best"))

    def merged(acc: Column) -> Column:
        parts, ranks = acc["parts"], acc["ranks"]

        def at(p: Column) -> Column:  # the lower one of the merged parts, from 0
            both = F.concat(F.get(parts, p), F.get(parts, p + 1))
            left = F.when(p > 0, F.array(rank(F.concat(F.get(parts, p - 1), both)))).otherwise(none)
            right = F.when(p + 2 < F.size(parts), F.array(rank(F.concat(both, F.get(parts, p + 2))))).otherwise(none)
            rest = F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 1, F.lit(0))), left, right, F.slice(ranks, p + 3, F.size(ranks)))
            return F.transform(F.array(rest), lambda r: state(F.concat(F.slice(parts, F.lit(1), p), F.array(both), F.slice(parts, p + 3, F.size(parts))), r))[0]

        none = F.array().cast("array<int>")
        return F.transform(F.array((F.array_position(ranks, acc["best"]) - 1).cast("int")), at)[0]

    n = F.length(data)
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(data, i, F.lit(1)))

    def folded(start: Column) -> Column:
        step = lambda acc, _: F.when(acc["best"] == NONE, acc).otherwise(merged(acc))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["parts"])

    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(data, i, F.lit(2))))).otherwise(F.array().cast("array<int>"))
    start = F.transform(F.array(pairs), lambda r: state(parts, r))[0]
    return F.transform(folded(start), lambda b: literal(b))


def _library_udf(path: str):
    """Ids of long pieces by the tokenizer library; the vocabulary is read once per Python worker."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(pieces: pd.Series) -> pd.Series:
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=read_ranks(path), special_tokens={})
        return pieces.map(lambda p: enc.encode_ordinary(p))

    return encode


def encode_words(words: DataFrame, literal: Lookup, path: str) -> DataFrame:
    """(piece, ids) of a table of distinct pieces."""
    raw = F.decode(F.encode("piece", "UTF-8"), "ISO-8859-1")
    short = words.where(F.octet_length("piece") <= FOLD_BYTES).select("piece", fold_merges(literal, raw).alias("ids"))
    long = words.where(F.octet_length("piece") > FOLD_BYTES).select("piece", _library_udf(path)(F.col("piece")).alias("ids"))
    return short.unionByName(long)


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    literal_words: int = 100_000,
    block: int = 2048,
    unique_ids: bool = False,
) -> DataFrame:
    """(id_col, ids array<int>), one row per distinct id. ``path``: the rank file. See the module for the method."""
    path = path or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    ranks = read_ranks(path)
    tokens = word_literal(ranks)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = texts if unique_ids else texts.groupBy("id").agg(F.min("text").alias("text"))
    unknown = (
        texts.select(F.explode(F.array_distinct(pieces_of(F.col("text")))).alias("piece"))
        .where(tokens(F.col("piece")).isNull())
        .groupBy("piece").agg(F.count("*").alias("n"))
    )
    unknown = Stage(unknown, "unknown").df
    folded = Stage(encode_words(unknown, rank_literal(ranks), path).join(unknown, "piece"), "pieces").df
    often = folded.orderBy(F.desc("n"), "piece").limit(literal_words).collect()
    known = word_literal(ranks, {r["piece"]: r["ids"] for r in often})
    if folded.limit(literal_words + 1).count() <= literal_words:
        return _encode_inline(one, known).withColumnRenamed("id", id_col)
    last = often[-1] if often else None
    rare = folded.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("piece") > last["piece"]))) if last else folded
    return _encode_joined(one, rare.select("piece", "ids"), known, block).withColumnRenamed("id", id_col)


def _encode_inline(one: DataFrame, words: Lookup) -> DataFrame:
    """All pieces by literal look-ups."""
    return one.select("id", F.flatten(F.transform(pieces_of(F.col("text")), lambda p: words(p))).alias("ids"))


def _encode_joined(one: DataFrame, rare: DataFrame, tokens: Lookup, block: int) -> DataFrame:
    """Frequent pieces by look-ups, ``rare`` ones by a join: a text asks for each of them once and gets back a small map.

    Texts are shuffled once as they are, to meet their maps; a piece that a large part of all texts holds is spread over
    tasks. Texts of more than ``block`` pieces go in blocks, each with a map of its own, so no map grows with a text.
    """
    rows = one.withColumn("size", F.length("text"))
    short, long = rows.where(F.col("size") <= block), rows.where(F.col("size") > block)  # a piece has at least a character
    wanted = lambda p: F.array_distinct(F.filter(p, lambda x: tokens(x).isNull()))
    ids_of = lambda p: F.flatten(F.transform(p, lambda x: F.coalesce(tokens(x), F.try_element_at("m", x))))

    def answered(asked: DataFrame, keys: list[str]) -> DataFrame:
        asked = Stage(asked, "asked").df
        return hub_join(asked, rare, "piece").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("piece", "ids"))).alias("m"))

    maps = answered(short.select("id", F.explode(wanted(pieces_of(F.col("text")))).alias("piece")), ["id"])
    plain = short.join(maps, "id", "left").select("id", ids_of(pieces_of(F.col("text"))).alias("ids"))
    pieces = long.select("id", pieces_of(F.col("text")).alias("p"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("p") - 1, F.lit(0)), F.lit(block))
    blocks = pieces.select("id", F.posexplode(F.transform(starts, lambda i: F.slice("p", i + 1, F.lit(block)))).alias("k", "p"))
    maps = answered(blocks.select("id", "k", F.explode(wanted(F.col("p"))).alias("piece")), ["id", "k"])
    parts = blocks.join(maps, ["id", "k"], "left").select("id", "k", ids_of(F.col("p")).alias("ids"))
    whole = parts.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda s: s["ids"])).alias("ids"))
    return plain.unionByName(whole)


def decode_ids(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``text``: the tokens' binary pieces, concatenated and read as UTF-8. Null ids give null, an empty list ''."""
    ranks = read_ranks(path or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"))
    by_id = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = base64.b64encode(token).decode()
    tokens = F.from_json(F.lit(json.dumps(by_id)), "array<binary>")
    parts = F.transform(F.col(ids_col), lambda i: F.get(tokens, i))
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return df.withColumn("text", F.decode(joined, "UTF-8"))
