"""Problem 6: ordered conversations from message rows.

Deliveries of a message are reduced to the latest edit by one aggregate. A message that names no thread takes its
parent's, by pointer jumping over just those rows. Messages are then range-partitioned and sorted by (thread, first
message, time, id): the secondary sort by which turns are numbered. One pass over each sorted partition runs a finite
automaton along every conversation: its letters are the first message, a reply by another person, any other turn, a
message that is no turn, and a fault (a parent that does not exist, a first message without text). Each letter is a
transition table of the states START, OPEN, ANSWERED and BROKEN; tables compose, so a conversation that lies across
partitions is judged from one table for each of its segments, and no conversation has to fit into one task.

Results by case: null and blank message ids are dropped; null, blank, invisible and removed texts are no turns; times
that cannot be read come last, ties go by id; a thread id that is null or blank follows from the parent; parents in a
circle belong to no thread; a thread whose first message is missing is dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.skew import hub_join
from loomline.session import Stage

#: Fixed value: white space of any kind.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: texts of white space, control and format characters and blank fillers only.
INVISIBLE = r"^[\p{Z}\p{Cc}\p{Cf}\p{Mn}⠀ᅟᅠㅤﾠ]*$"
#: Fixed value: notices left in place of a removed message.
REMOVED = (
    r"(?i)^[\s\p{Z}\[(<{*_]*(?:(?:this\s+|the\s+|a\s+)?(?:message|post|comment)\s+(?:(?:was|has\s+been|is)\s+)?)?"
    r"(?:deleted|removed|retracted|withdrawn|unsent|recalled)"
    r"(?:\s+by\s+(?:its|the|an?)\s+(?:author|sender|owner|user|moderator|admin(?:istrator)?))?[\s\p{Z}\])>}*_.!]*$"
)
BOT = r"(?i)@bot\.example[\s\p{Z}]*$"


def readable(text: Column) -> Column:
    """Whether a text says something: not null, blank, invisible or a removal notice."""
    return F.coalesce(~text.rlike(INVISIBLE) & ~text.rlike(REMOVED), F.lit(False))


def iso_instant(text: Column) -> Column:
    """A timestamp from ISO text with or without zone (none: UTC); null if it cannot be read."""
    t = F.btrim(text, F.lit(SPACES))
    dated = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$")
    zoned = t.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$") & t.rlike(r"[T ]\d{2}:\d{2}")
    return F.when(dated, F.when(zoned, t).otherwise(F.concat(t, F.when(t.rlike(r"[T ]"), "Z").otherwise("T00:00:00Z")))).try_cast("timestamp")


def _id(c: str) -> Column:
    return F.nullif(F.btrim(F.col(c), F.lit(SPACES)), F.lit(""))


EXTRA = ("author", "created", "text")


def latest_deliveries(messages: DataFrame, extra: tuple[str, ...] = EXTRA) -> DataFrame:
    """One row per trimmed message id: the latest ``updated``, then the latest ``ingested_at``.

    What the texts say about a message is decided before the shuffle, so they travel only if ``extra`` asks for them.
    """
    fields = [
        iso_instant(F.col("updated")).alias("edited"), F.col("ingested_at").alias("at"), readable(F.col("text")).alias("ok"), _id("parent_id").alias("parent"),
        _id("thread_id").alias("thread"), F.lower(F.btrim(F.coalesce("author", F.lit("")), F.lit(SPACES))).alias("who"), F.coalesce(F.col("person_email").rlike(BOT), F.lit(False)).alias("bot"),
        iso_instant(F.col("created")).alias("time"),
    ]
    rows = messages.select(_id("message_id").alias("id"), F.struct(*fields, *extra).alias("m")).where("id is not null")
    return rows.groupBy("id").agg(F.max("m").alias("m")).select("id", "m.*").drop("edited", "at")


def parents(latest: DataFrame) -> DataFrame:
    """(id, thread, parent, there, named) of the messages whose parent has to be looked up: it is not the thread's first message.

    named: the thread that the parent names, or the parent itself if it is a first message.
    """
    asks = latest.where("parent is not null and (thread is null or parent <> thread)").select("id", "thread", "parent")
    known = latest.select(F.col("id").alias("parent"), F.lit(True).alias("there"), F.coalesce("thread", F.when(F.col("parent").isNull(), F.col("id"))).alias("named"))
    return hub_join(asks, known, "parent", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def resolve_threads(asked: DataFrame) -> DataFrame:
    """(id, thread) of messages that name no thread: the parent's thread, by pointer jumping (depth 2^n in n rounds).

    What ends at a missing message takes that as its thread; what goes in a circle takes its own id.
    """
    rows = asked.where("thread is null").select("id", F.col("parent").alias("to"), F.when(F.col("there"), F.col("named")).otherwise(F.col("parent")).alias("thread"))
    stage = Stage(rows, "pointers")
    left = stage.df.where("thread is null").count()
    for _ in range(max(left, 1).bit_length() + 1 if left else 0):
        ahead = stage.df.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("thread").alias("found"))
        moved = hub_join(stage.df.where("thread is null").select("id", "to"), ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("found").alias("thread"))
        new = Stage(stage.df.where("thread is not null").unionByName(moved), "pointers")
        stage.drop()
        stage = new
        left = stage.df.where("thread is null").count()
        if not left:
            break
    return stage.df.select("id", F.coalesce("thread", "id").alias("thread"))


#: States of the automaton and, by letter, the state that each of them goes to.
START, OPEN, ANSWERED, BROKEN = range(4)
FIRST, REPLY, TURN, VOID, FAULT = range(5)
DELTA = np.array([
    [OPEN, OPEN, ANSWERED, BROKEN],  # the first message, readable
    [BROKEN, ANSWERED, ANSWERED, BROKEN],  # a turn by another person
    [BROKEN, OPEN, ANSWERED, BROKEN],  # a turn by the starter or a bot
    [BROKEN, OPEN, ANSWERED, BROKEN],  # a message that is no turn
    [BROKEN, BROKEN, BROKEN, BROKEN],  # a fault
])


def compose(tables: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One table for each segment of ``tables`` (n, 4) that starts at ``begin``: its tables one after the other, pairwise in log n rounds."""
    segment = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(tables))))
    while len(tables) > len(begin):
        starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        place = np.arange(len(segment)) - starts[np.cumsum(np.append(False, segment[1:] != segment[:-1]))]
        even = np.flatnonzero(place % 2 == 0)
        pair = (even + 1 < len(segment)) & (segment[np.minimum(even + 1, len(segment) - 1)] == segment[even])
        merged = tables[even].copy()
        merged[pair] = np.take_along_axis(tables[even[pair] + 1], merged[pair], axis=1)
        tables, segment = merged, segment[even]
    return tables


JUDGED = "thread string, id string, turn long, role int, part int, seq int, who string, bot boolean, tables array<int>, starter string, low string, high string"
_ARROW = pa.schema([
    ("thread", pa.string()), ("id", pa.string()), ("turn", pa.int64()), ("role", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("who", pa.string()), ("bot", pa.bool_()),
    ("tables", pa.list_(pa.int32())), ("starter", pa.string()), ("low", pa.string()), ("high", pa.string()),
])
USER, ASSISTANT, SYSTEM = range(3)


def _judge(hold: int):
    """The automaton over sorted messages. Conversations inside a partition are decided here; of those at its edges, and of
    every ``hold`` messages of a longer one, each turn comes out with its place in the segment, and each segment with its table."""

    def emit(n, **cols):
        return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, seq, edge = None, 0, True
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            held, seq, edge = yield from step(held, part, seq, edge, False)
        if held is not None and held.num_rows:
            yield from step(held, part, seq, edge, True)

    def step(rows, part, seq, edge, last):
        """Judges what is complete in ``rows``; gives back the rest."""
        n = rows.num_rows
        if not n:
            return rows, seq, edge
        thread = rows["thread"].combine_chunks()
        begin = np.append(0, np.flatnonzero(pc.not_equal(thread[1:], thread[:-1]).to_numpy(zero_copy_only=False)) + 1)
        if edge and (len(begin) > 1 or n > hold or last):  # the first conversation may have begun in an earlier partition
            end = begin[1] if len(begin) > 1 else n
            yield from segment(rows.slice(0, end), part, seq)
            return (yield from step(rows.slice(end).combine_chunks(), part, seq + 1, len(begin) == 1, last)) if end < n else (rows.slice(n), seq + 1, True)
        if len(begin) > 1 and not edge:
            yield from whole(rows.slice(0, begin[-1]), begin[:-1])
            return (yield from step(rows.slice(begin[-1]).combine_chunks(), part, seq, False, last))
        if last or n > hold:  # the last one may go on in a later partition
            yield from segment(rows, part, seq)
            return rows.slice(n), seq + 1, True
        return rows, seq, edge

    def letters(rows, starter):
        ord_ = rows["ord"].to_numpy()
        ok, bot = rows["ok"].to_numpy(zero_copy_only=False), rows["bot"].to_numpy(zero_copy_only=False)
        other = pc.fill_null(pc.not_equal(rows["who"], starter), False).to_numpy(zero_copy_only=False) if starter is not None else np.zeros(len(ok), dtype=bool)
        out = np.where(ok, np.where(other & ~bot, REPLY, TURN), VOID)
        out = np.where(ord_ == 1, np.where(ok, FIRST, FAULT), out)
        return np.where(ord_ == 0, FAULT, out), ok & (ord_ > 0), bot, other

    def starters(rows, begin, size):
        """The author of the first message for each row, null where it is missing."""
        ord_ = rows["ord"].to_numpy()
        root = np.full(len(begin), -1)
        at = np.flatnonzero(ord_ == 1)
        root[np.searchsorted(begin, at, side="right") - 1] = at
        return pc.take(rows["who"].combine_chunks(), pa.array(np.repeat(root, size), mask=np.repeat(root < 0, size)))

    def whole(rows, begin):
        size = np.diff(np.append(begin, rows.num_rows))
        letter, turn, bot, other = letters(rows, starters(rows, begin, size))
        kept = np.repeat(compose(DELTA[letter], begin)[:, START] == ANSWERED, size) & turn
        count = np.cumsum(turn)
        number = count - np.repeat(count[begin] - turn[begin], size)
        role = np.where(bot, SYSTEM, np.where(other, ASSISTANT, USER))
        keep = pa.array(np.flatnonzero(kept))
        yield emit(len(keep), thread=pc.take(rows["thread"].combine_chunks(), keep), id=pc.take(rows["id"].combine_chunks(), keep), turn=pa.array(number[kept]), role=pa.array(role[kept]))

    def segment(rows, part, seq):
        n = rows.num_rows
        letter, turn, bot, _ = letters(rows, None)
        table = compose(DELTA[letter], np.array([0]))[0]
        first = np.flatnonzero(rows["ord"].to_numpy() == 1)
        who = rows["who"].combine_chunks()
        people = pc.take(who, pa.array(np.flatnonzero(turn & ~bot)))
        ends = pc.min_max(people)
        one = lambda x: pa.array([x])
        yield emit(1, thread=rows["thread"].combine_chunks()[:1], part=one(part), seq=one(seq), turn=one(int(turn.sum())), tables=one([int(x) for x in table]),
                   starter=one(who[int(first[0])].as_py() if len(first) else None), low=one(ends["min"].as_py()), high=one(ends["max"].as_py()))
        at = pa.array(np.flatnonzero(turn))
        k = len(at)
        yield emit(k, thread=pc.take(rows["thread"].combine_chunks(), at), id=pc.take(rows["id"].combine_chunks(), at), turn=pa.array(np.arange(1, k + 1)), part=pa.array(np.full(k, part)), seq=pa.array(np.full(k, seq)), who=pc.take(who, at), bot=pc.take(rows["bot"].combine_chunks(), at))

    return run


def conversations(messages: DataFrame, hold: int = 50_000, extra: tuple[str, ...] = EXTRA) -> DataFrame:
    """(thread_id, turn_no, message_id, role and ``extra`` columns) of the kept conversations.

    role: user for the starter of the thread, system for bots, assistant for all others.
    """
    latest = Stage(latest_deliveries(messages, extra), "latest").df
    asked = Stage(parents(latest), "parents").df
    cols = ["thread", F.when(F.col("id") == F.col("thread"), 1).otherwise(2).alias("ord"), "time", "id", "who", "bot", "ok"]
    named = latest.where("thread is not null or parent is null").withColumn("thread", F.coalesce("thread", "id")).select(cols)
    resolved = resolve_threads(asked)
    follow = latest.where("thread is null and parent is not null").drop("thread").join(resolved, "id").select(cols)
    astray = asked.where("not there").select("id", "thread")
    astray = astray.where("thread is not null").select("thread").union(astray.where("thread is null").select("id").join(resolved, "id").select("thread"))
    faults = astray.distinct().select("thread", F.lit(0).alias("ord"), F.lit(None).cast("timestamp").alias("time"), F.lit("").alias("id"), F.lit("").alias("who"), F.lit(False).alias("bot"), F.lit(False).alias("ok"))
    rows = named.unionByName(follow).unionByName(faults)
    order = ["thread", "ord", F.col("time").asc_nulls_last(), "id"]
    judged = Stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_judge(hold), JUDGED), "judged").df
    by_thread = Window.partitionBy("thread")
    so_far = by_thread.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    segments = judged.where("tables is not null").select(
        "thread", "part", "seq", F.coalesce(F.sum("turn").over(so_far), F.lit(0)).alias("before"), F.max("starter").over(by_thread).alias("starter"),
        F.min("low").over(by_thread).alias("low"), F.max("high").over(by_thread).alias("high"),
        F.array_sort(F.collect_list(F.struct("part", "seq", "tables")).over(by_thread)).alias("all"),
    )
    state = F.aggregate("all", F.lit(START), lambda s, x: F.get(x["tables"], s))
    someone = (F.col("low") != F.col("starter")) | (F.col("high") != F.col("starter"))
    open_or_answered = (state == OPEN) | (state == ANSWERED)
    fine = segments.where(open_or_answered & F.coalesce(someone, F.lit(False))).select("thread", "part", "seq", "before", F.col("starter").alias("by"))
    role = F.when(F.col("bot"), SYSTEM).when(F.col("who") == F.col("by"), USER).otherwise(ASSISTANT)
    edges = judged.where("tables is null and part is not null").join(fine, ["thread", "part", "seq"]).select("thread", "id", (F.col("turn") + F.col("before")).alias("turn"), role.alias("role"))
    turns = judged.where("part is null").select("thread", "id", "turn", "role").unionByName(edges)
    if extra:
        turns = turns.join(latest.select("id", *extra), "id")
    names = F.when(F.col("role") == USER, "user").when(F.col("role") == SYSTEM, "system").otherwise("assistant")
    return turns.select(F.col("thread").alias("thread_id"), F.col("turn").alias("turn_no"), F.col("id").alias("message_id"), names.alias("role"), *extra)
