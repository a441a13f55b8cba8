"""Problem 2: the same or nearly the same pairs across splits.

The texts of all records, question and answer each ended by a mark, are one long sequence of words, kept in partitions.
Its suffix array: every place with ``span`` words after it begins a suffix, but for places of training texts whose words
occur in no evaluation text, as a bitmap of the evaluation texts' runs of ``span`` words tells (it errs only by letting
others through), so every common run of ``span`` words is seen at each of its places. The suffixes are
sorted by their words over range partitions, a suffix by its first ``depth`` words. A pass over each sorted partition
compares neighbours: where their common prefix has at least ``span`` words they belong to one run, and a run from both
sides of the split gives the spans that an evaluation record shares with a training record. Runs at the edges of a
partition are completed by their first ``span`` words. Spans merge into the coverage of each record (``coverage``), and
the pairs they reveal are candidates. A candidate is an overlap if, in question and in answer, the distinct words in both
are at least ``share`` of those in either.

Edits can be spread so that no run has ``span`` words, and runs that pair more than ``wide`` times (phrases that many records
use) would pair within a group. For both there is an exact way, so that no link is lost: two questions with a Jaccard
index of ``share`` have a common word among the rarest (1 - share) of either (prefix filter), early enough in both orders
(position filter); one equality join by such words tests length, position and 64-bit sketches of question and answer.

Copies are one record: everything runs over distinct pairs of word sequences and is expanded to ids at the end.

Results by case: records without a split (null, blank or unknown label, no row) take no part; an id in several splits
takes part in each; an id with several texts is compared by each of them; null texts are texts without words; two texts
without words count as equal; ids compare as they stand.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.words import strip, words
from loomline.session import Stage, staging

#: Spellings of the split labels, trimmed and in lower case.
LABELS = {
    "train": "train", "training": "train", "valid": "valid", "validation": "valid", "val": "valid", "dev": "valid",
    "test": "test", "testing": "test",
}
#: Class ids and run keys are broadcast up to this many rows (8 bytes each), counted before; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Hash cells by which words are ordered in the exact join.
CELLS = 65_536
#: Words of a shared run, distance of the places that begin a suffix, pairs of a run beyond which the exact join takes over, words by which suffixes are sorted.
SPAN, STEP, WIDE, DEPTH = 12, 1, 400, 14
#: Bits of the bitmap of the evaluation texts' runs for each of their words, and its largest size as a power of 2 (16 MB); beyond it more training places get through.
RUN_BITS, MOST_BITS = 16, 27


def split_label(c: Column) -> Column:
    """train, valid or test; null for anything else."""
    label, out = F.lower(strip(c)), None
    for spelling, name in LABELS.items():
        out = F.when(label == spelling, name) if out is None else out.when(label == spelling, name)
    return out


def _classes(records: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: qa_id, split, source_type, class) and (classes: class, t, e, q, a): one row per distinct pair of word sequences.

    Texts cross the network once, one row per class; everything else moves ids only.
    """
    labels = splits.select("qa_id", split_label(F.col("split_name")).alias("split")).where("split is not null").distinct()
    same = F.xxhash64(words(F.col("question")), F.lit("|"), words(F.col("answer")))
    texts = records.select("qa_id", F.lower(strip(F.col("source_type"))).alias("source_type"), "question", "answer", same.alias("class"))
    members = Stage(texts.select("qa_id", "source_type", "class").join(labels, "qa_id").distinct(), "members").df
    flags = members.groupBy("class").agg(
        F.max((F.col("split") == "train").cast("int")).alias("t"), F.max((F.col("split") != "train").cast("int")).alias("e")
    )
    one = texts.groupBy("class").agg(F.first("question").alias("q"), F.first("answer").alias("a"))
    split = one.join(flags, "class").select("class", "t", "e", words(F.col("q")).alias("q"), words(F.col("a")).alias("a"))
    return members, Stage(split, "classes").df


SUFFIX = "key binary, class long, pos int, e boolean, t boolean"
SHARED = "ec long, tc long, e_pos int, t_pos int, run int, prefix binary, e boolean, t boolean"


def _places(ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``ids`` with ``span`` words of their text from there on, hash of these words); ids: the words of several texts, text i ends at ends[i]."""
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(span, dtype=np.uint64)])
    gram = np.zeros(n, dtype=np.uint64)
    for j in range(span):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + n]
    gram ^= gram >> np.uint64(29)
    places = np.flatnonzero(np.arange(n) + span <= np.repeat(ends, lengths))
    return places, gram[places] * np.uint64(0xBF58476D1CE4E5B9)


def _texts(batch) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words of all texts of a batch, edges of the texts)."""
    lists = batch.column("h")
    edges = lists.offsets.to_numpy()
    ids = lists.values.to_numpy()[edges[0] : edges[-1]].astype(np.uint32).astype(np.uint64)
    ids[ids == 0] = 1  # 0 stands for no word
    return ids, edges.astype(np.int64) - edges[0]


def _cells(gram: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit) of a hash in a bitmap of 2 ** power bits."""
    cell = gram >> np.uint64(64 - power)
    return (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8)


def _run_bits(span: int, power: int):
    def run(batches):
        bits = np.zeros(2 ** (power - 3), dtype=np.uint8)
        for batch in batches:
            ids, edges = _texts(batch)
            at, bit = _cells(_places(ids, edges[1:], np.diff(edges), span)[1], power)
            np.bitwise_or.at(bits, at, bit)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    return run


def _suffix_rows(span: int, depth: int, power: int, sent):
    def run(batches):
        bits = sent.value
        for batch in batches:
            ids, edges = _texts(batch)
            places, gram = _places(ids, edges[1:], np.diff(edges), span)
            row = np.searchsorted(edges, places, side="right") - 1
            at, bit = _cells(gram, power)
            keep = batch.column("e").to_numpy(zero_copy_only=False)[row] | ((bits[at] & bit) != 0)
            places, row = places[keep], row[keep]
            grid = places[:, None] + np.arange(depth)
            words_at = np.where(grid < edges[row + 1][:, None], ids[np.minimum(grid, max(len(ids) - 1, 0))], 0) if len(ids) else grid
            data = words_at.astype(">u4").tobytes()
            key = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer((np.arange(len(places) + 1) * 4 * depth).astype(np.int32)), pa.py_buffer(data)])
            take = pa.array(row)
            cols = [key, batch.column("class").take(take), pa.array((places - edges[row]).astype(np.int32)), batch.column("e").take(take), batch.column("t").take(take)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "class", "pos", "e", "t"])

    return run


def _shared(ec, tc, e_pos, t_pos, run, prefix=None, e=None, t=None) -> pa.RecordBatch:
    n = len(ec)
    none = lambda kind: pa.nulls(n, kind)
    cols = [
        pa.array(ec, pa.int64()), none(pa.int64()) if tc is None else pa.array(tc, pa.int64()), pa.array(e_pos, pa.int32()),
        none(pa.int32()) if t_pos is None else pa.array(t_pos, pa.int32()), pa.array(run, pa.int32()),
        none(pa.binary()) if prefix is None else pa.array(prefix, pa.binary()), none(pa.bool_()) if e is None else pa.array(e), none(pa.bool_()) if t is None else pa.array(t),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["ec", "tc", "e_pos", "t_pos", "run", "prefix", "e", "t"])


def _runs(words_at, cls, pos, e, t, common, begin, span, wide):
    """Shared spans of the runs that begin at ``begin`` (the last entry ends the last run); common[i]: words that i - 1 and i share."""
    size = np.diff(begin)
    if not len(size):
        return
    ne, nt = np.add.reduceat(e.astype(np.int64), begin[:-1]), np.add.reduceat(t.astype(np.int64), begin[:-1])
    both = (size > 1) & (ne > 0) & (nt > 0)
    narrow = both & (ne * nt <= wide)
    far = np.flatnonzero(np.repeat(both & ~narrow, size) & e)
    if len(far):
        yield _shared(cls[far], None, pos[far], None, np.full(len(far), span))
    end = np.repeat(np.where(narrow, begin[1:], 0), size)  # per row: the end of its run, 0 for rows of other runs
    i = np.flatnonzero(end > np.arange(len(end)) + 1)
    near = np.full(len(i), words_at.shape[1])
    d = 0
    while len(i):
        d += 1
        near = np.minimum(near, common[i + d])
        for x, y in ((i, i + d), (i + d, i)):
            hit = e[x] & t[y] & (cls[x] != cls[y])
            if hit.any():
                yield _shared(cls[x[hit]], cls[y[hit]], pos[x[hit]], pos[y[hit]], near[hit])
        more = i + d + 1 < end[i]
        i, near = i[more], near[more]


def _neighbours(span: int, wide: int):
    """Shared spans from sorted suffixes; of an open run at most ``wide`` + 2 rows and a batch are held, the rest is completed as an edge."""

    def run(batches):
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key")
            depth = len(key[0].as_py()) // 4
            start = key.offset
            offs = np.frombuffer(key.buffers()[1], dtype=np.int32)[start : start + len(key) + 1]
            grid = np.frombuffer(key.buffers()[2], dtype=">u4", count=(offs[-1] - offs[0]) // 4, offset=int(offs[0])).reshape(-1, depth)
            part = [grid, *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("class", "pos", "e", "t")]]
            if held is not None:
                part = [np.concatenate([a, b]) for a, b in zip(held, part)]
            grid, cls, pos, e, t = part
            same = (grid[1:] == grid[:-1]) & (grid[1:] != 0)
            common = np.concatenate([[0], np.where(same.all(axis=1), depth, same.argmin(axis=1))])
            begin = np.flatnonzero(common < span)
            if first and len(begin) > 1:
                yield from _edge(grid, cls, pos, e, t, span, 0, begin[1])
                begin, first = begin[1:], False
            if len(begin) > 1:
                a, b = begin[0], begin[-1]
                yield from _runs(*[x[a:b] for x in (grid, cls, pos, e, t, common)], begin - a, span, wide)
            open_at = begin[-1]
            if len(cls) - open_at > wide + 2:
                yield from _edge(grid, cls, pos, e, t, span, open_at, len(cls) - 1)
                open_at, first = len(cls) - 1, True
            held = [x[open_at:].copy() for x in (grid, cls, pos, e, t)]
        if held is not None:
            yield from _edge(*held, span, 0, len(held[1]))

    return run


def _edge(grid, cls, pos, e, t, span, a, b):
    """Rows a:b of a run that may go on elsewhere, with the words that name it; a suffix of fewer words has no run."""
    if b > a and grid[a, span - 1]:
        names = grid[a:b, :span].astype(">u4").tobytes()
        width = 4 * span
        yield _shared(cls[a:b], None, pos[a:b], None, np.full(b - a, span), [names[k * width : (k + 1) * width] for k in range(b - a)], e[a:b], t[a:b])


def shared_spans(classes: DataFrame, span: int = SPAN, wide: int = WIDE, depth: int = DEPTH) -> DataFrame:
    """(ec, tc, e_pos, t_pos, run): spans of at least ``span`` words that an evaluation class shares with a training class.

    tc is null where the run has too many pairs; such a span is named once for each of its evaluation classes.
    """
    mark = F.array(F.lit(2))
    ids = lambda c: F.transform(c, lambda w: F.hash(w))
    rows = classes.select("class", F.coalesce(F.col("e") == 1, F.lit(False)).alias("e"), F.coalesce(F.col("t") == 1, F.lit(False)).alias("t"), F.concat(ids("q"), mark, ids("a"), mark).alias("h"))
    spark = classes.sparkSession
    many = classes.where("e = 1").agg(F.sum(F.size("q") + F.size("a") + 2)).first()[0] or 0
    power = min(MOST_BITS, max(10, (RUN_BITS * many).bit_length()))
    bits = np.zeros(2 ** (power - 3), dtype=np.uint8)
    for part in rows.where("e").select("h").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(_run_bits(span, power), "bits binary").toLocalIterator():
        bits |= np.frombuffer(part["bits"], dtype=np.uint8)
    suffixes = rows.mapInArrow(_suffix_rows(span, depth, power, spark.sparkContext.broadcast(bits)), SUFFIX)
    order = suffixes.repartitionByRange("key", "class").sortWithinPartitions("key", "class", "pos")
    found = Stage(order.mapInArrow(_neighbours(span, wide), SHARED), "spans").df
    edges = found.where("prefix is not null").select("prefix", F.col("ec").alias("class"), F.col("e_pos").alias("pos"), "run", "e", "t")
    counts = edges.groupBy("prefix").agg(F.count_if("t").alias("nt"), F.count_if("e").alias("ne")).where("nt > 0 and ne > 0")
    e = edges.where("e").select("prefix", F.col("class").alias("ec"), F.col("pos").alias("e_pos"), "run")
    t = edges.where("t").select("prefix", F.col("class").alias("tc"), F.col("pos").alias("t_pos"))
    narrow, far = counts.where(F.col("nt") * F.col("ne") <= wide).select("prefix"), counts.where(F.col("nt") * F.col("ne") > wide).select("prefix")
    cols = ["ec", "tc", "e_pos", "t_pos", "run"]
    closed = e.join(narrow, "prefix").join(t, "prefix").where("ec <> tc").select(cols)
    covered = e.join(far, "prefix").select("ec", F.lit(None).cast("long").alias("tc"), "e_pos", F.lit(None).cast("int").alias("t_pos"), "run")
    return found.where("prefix is null").select(cols).unionByName(closed).unionByName(covered)


def _sketch(hashes: Column) -> Column:
    """A 64-bit set sketch: the bits in which two sketches differ are at most the words in which the sets do."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda x, h: x.bitwiseOR(F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))))


def _prefixes(classes: DataFrame, share: float, cells: int) -> DataFrame:
    """(word, class, t, e, n, i, na, s0, s1): words of each question's prefix in one global order, rare words first.

    Words are ordered by how many questions hold a word of the same hash cell, then by hash; any order is exact, this one
    is selective for all words and needs ``cells`` numbers at the driver, however large the vocabulary. A question
    without words can only equal another one, so its marked answer words stand in.
    """
    sets = classes.select("class", "t", "e", F.array_distinct("q").alias("q"), F.array_distinct("a").alias("a"))
    sets = sets.withColumn("q", F.when(F.size("q") > 0, F.col("q")).otherwise(F.transform("a", lambda w: F.concat(F.lit("\0"), w))))
    hashes = F.transform("q", lambda w: F.xxhash64(w))
    cell = lambda h: F.pmod(h, F.lit(cells)).cast("int")
    counts = [0] * cells
    for r in sets.select(F.explode(F.transform(hashes, cell)).alias("c")).groupBy("c").count().collect():
        counts[r["c"]] = r["count"]
    often = F.from_json(F.lit(json.dumps(counts, separators=(",", ":"))), "array<bigint>")
    ordered = F.array_sort(F.transform(hashes, lambda h: F.struct(F.get(often, cell(h)).alias("r"), h.alias("w"))))
    answer = _sketch(F.transform("a", lambda w: F.xxhash64(w)))
    rows = Stage(sets.select("class", "t", "e", F.size("a").alias("na"), answer.alias("s1"), F.transform(ordered, lambda x: x["w"]).alias("o")), "ordered").df
    n = F.size("o")
    prefix = F.slice("o", F.lit(1), (n - F.ceil(n * share - 1e-9) + 1).cast("int"))
    rows = rows.select("class", "t", "e", n.alias("n"), "na", _sketch(F.col("o")).alias("s0"), "s1", prefix.alias("p"))
    return rows.select("class", "t", "e", "n", "na", "s0", "s1", F.posexplode("p").alias("i", "word"))


def _prefix_pairs(prefixes: DataFrame, share: float) -> DataFrame:
    """(ec, tc) of all pairs that can pass: prefix, length and position filters and sketches, all inside one equality join."""
    cols = ["class", "n", "i", "na", "s0", "s1"]
    e = prefixes.where("e = 1").select("word", *[F.col(c).alias(f"e_{c}") for c in cols])
    t = prefixes.where("t = 1").select("word", *[F.col(c).alias(f"t_{c}") for c in cols])
    c = F.col
    need = F.lit(share / (1 + share)) * (c("e_n") + c("t_n")) - 1e-9
    differ = lambda x, y: (x + y) * ((1 - share) / (1 + share)) + 1e-9
    fits = (
        (F.least(c("e_n") - c("e_i"), c("t_n") - c("t_i")) >= need)
        & (F.least("e_n", "t_n") >= F.greatest("e_n", "t_n") * share - 1e-9)
        & (F.least("e_na", "t_na") >= F.greatest("e_na", "t_na") * share - 1e-9)
        & (F.bit_count(c("e_s0").bitwiseXOR(c("t_s0"))) <= differ(c("e_n"), c("t_n")))
        & (F.bit_count(c("e_s1").bitwiseXOR(c("t_s1"))) <= differ(c("e_na"), c("t_na")))
        & (c("e_class") != c("t_class"))
    )
    return e.join(t, (e["word"] == t["word"]) & fits).select(c("e_class").alias("ec"), c("t_class").alias("tc"))


def _jaccard_at_least(x: Column, y: Column, share: float) -> Column:
    common, n = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(n == 0, True).otherwise(common >= share * n - 1e-9)


def class_pairs(classes: DataFrame, share: float = 0.7, span: int = SPAN, wide: int = WIDE, cells: int = CELLS, exact: bool = True) -> DataFrame:
    """(ec, tc): classes of an evaluation and a training record, not equal, that pass the test in both texts.

    exact=False leaves out the prefix join, so that pairs without a long common run are lost; for measuring.
    """
    with staging() as stages:
        pairs = shared_spans(classes, span, wide).where("tc is not null").select("ec", "tc")
        if exact:
            pairs = pairs.unionByName(_prefix_pairs(_prefixes(classes, share, cells), share))
        pairs = stages.keep(Stage(pairs.distinct(), "pairs"))
    named = Stage(pairs.select(F.col("ec").alias("class")).union(pairs.select(F.col("tc").alias("class"))).distinct(), "named").df
    if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    sets = classes.join(named, "class", "left_semi").select("class", F.array_distinct("q").alias("q"), F.array_distinct("a").alias("a"))
    one = sets.select(F.col("class").alias("ec"), F.col("q").alias("eq"), F.col("a").alias("ea"))
    two = sets.select(F.col("class").alias("tc"), F.col("q").alias("tq"), F.col("a").alias("ta"))
    both = pairs.join(one, "ec").join(two, "tc")
    return both.where(_jaccard_at_least(F.col("ea"), F.col("ta"), share) & _jaccard_at_least(F.col("eq"), F.col("tq"), share)).select("ec", "tc")


def _links(records: DataFrame, splits: DataFrame, share: float, span: int, wide: int, exact: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links of classes: ec, tc)."""
    members, classes = _classes(records, splits)
    near = class_pairs(classes, share, span, wide, exact=exact)
    same = classes.where("t = 1 and e = 1").select(F.col("class").alias("ec"), F.col("class").alias("tc"))
    return members, classes, near.unionByName(same)


def cross_split_overlaps(records: DataFrame, splits: DataFrame, share: float = 0.7, span: int = SPAN, wide: int = WIDE, exact: bool = True) -> DataFrame:
    """(eval_id, eval_split, eval_source, train_id) of all overlaps of an evaluation record with a training record."""
    members, _, links = _links(records, splits, share, span, wide, exact)
    e = members.where("split <> 'train'").select(F.col("class").alias("ec"), F.col("qa_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source_type").alias("eval_source"))
    t = members.where("split = 'train'").select(F.col("class").alias("tc"), F.col("qa_id").alias("train_id")).distinct()
    return links.join(e, "ec").join(t, "tc").where("eval_id <> train_id").select("eval_id", "eval_split", "eval_source", "train_id").distinct()


def found_overlaps(records: DataFrame, splits: DataFrame) -> DataFrame:
    """p2_found: (qa_id_a, qa_id_b), the smaller id first."""
    pairs = cross_split_overlaps(records, splits)
    return pairs.select(F.least("eval_id", "train_id").alias("qa_id_a"), F.greatest("eval_id", "train_id").alias("qa_id_b")).distinct()


def overlap_counts(records: DataFrame, splits: DataFrame) -> DataFrame:
    """(split_name, source_type, records, pairs): evaluation records with an overlap, and their pairs, by split and source.

    Counted from the sizes of the classes, no pair of ids is made; an id with several texts counts with each of them. Of
    a record that is in training itself, its own copy does not count.
    """
    members, _, links = _links(records, splits, 0.7, SPAN, WIDE)
    links = Stage(links, "links").df
    e = members.where("split <> 'train'").select(F.col("class").alias("ec"), "qa_id", "split", "source_type").distinct()
    t = members.where("split = 'train'").select(F.col("class").alias("tc"), "qa_id").distinct()
    partners = links.join(t.groupBy("tc").agg(F.count("*").alias("n")), "tc").groupBy("ec").agg(F.sum("n").alias("n"))
    own = e.select("ec", "qa_id").distinct().join(t, "qa_id").join(links, ["ec", "tc"]).groupBy("ec", "qa_id").agg(F.count("*").alias("own"))
    each = e.join(partners, "ec").join(own, ["ec", "qa_id"], "left").withColumn("pairs", F.col("n") - F.coalesce("own", F.lit(0))).where("pairs > 0")
    return each.groupBy(F.col("split").alias("split_name"), "source_type").agg(F.countDistinct("qa_id").alias("records"), F.sum("pairs").alias("pairs"))


def coverage(records: DataFrame, splits: DataFrame, span: int = SPAN, wide: int = WIDE) -> DataFrame:
    """(qa_id, split_name, source_type, words, covered): words of each evaluation record, and those that stand in a span shared with training.

    Spans merge, so a word counts once. A record of a class that is in training as a whole is covered as a whole.
    """
    members, classes = _classes(records, splits)
    spans = shared_spans(classes, span, wide).groupBy(F.col("ec").alias("class"), "e_pos").agg(F.max("run").alias("run"))
    lists = spans.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("e_pos", (F.col("e_pos") + F.col("run")).alias("to")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    merged = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<e_pos:int,to:int>>")), zero,
        lambda a, s: F.struct((a["n"] + F.greatest(s["to"] - F.greatest(s["e_pos"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["to"]).alias("to")), lambda a: a["n"],
    )
    words_of = F.size("q") + F.size("a")
    rows = classes.where("e = 1").select("class", "t", words_of.cast("bigint").alias("words")).join(lists, "class", "left")
    each = rows.select("class", "words", F.when(F.col("t") == 1, F.col("words")).otherwise(F.least("words", merged.cast("bigint"))).alias("covered"))
    e = members.where("split <> 'train'").select("qa_id", "class", F.col("split").alias("split_name"), "source_type").distinct()
    return e.join(each, "class").select("qa_id", "split_name", "source_type", "words", "covered")
