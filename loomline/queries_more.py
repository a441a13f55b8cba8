"""Queries for single functions and smaller operators, each with SQL that states its result in other terms where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions import values as V
from loomline.models import PassageGenerator
from loomline.operators import generation, qa
from loomline.plans import answers, index, retrieve
from loomline.session import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

WS = r"[\t-\r \x{85}\p{Z}]"
_FLAT = lambda c: f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"
_STRIP = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""
SELECT doc_id, epoch_us(date_trunc('second', created_at)) AS whole_us, epoch_us(date_trunc('day', created_at)) AS day_us, NULL::BIGINT AS bad_us FROM documents WHERE created_at IS NOT NULL""")
def pdf_dates(spark: SparkSession, base: str) -> DataFrame:
    """PDF dates written from a time, whole and by day only, are read back; a month 13 is none."""
    d = load(spark, base, "documents").where("created_at is not null")
    read = lambda c: F.unix_micros(V.pdf_date(c))
    at = lambda form: F.concat(F.lit("D:"), F.date_format("created_at", form))
    return d.select("doc_id", read(at("yyyyMMddHHmmss")).alias("whole_us"), read(at("yyyyMMdd")).alias("day_us"), read(F.concat(F.date_format("created_at", "yyyy"), F.lit("13"))).alias("bad_us"))


@query("""
SELECT doc_id, CAST(created_at AS DATE) AS day, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(created_at, '%Y-%m-%d %H:%M') AS shown FROM documents WHERE created_at IS NOT NULL""")
def date_forms(spark: SparkSession, base: str) -> DataFrame:
    d = load(spark, base, "documents").where("created_at is not null")
    utc = V.utc_text(F.col("created_at"))
    return d.select("doc_id", V.compact_date(F.date_format("created_at", "ddMMyyyy")).alias("day"), utc.alias("utc"), V.display_time(utc).alias("shown"))


@query(f"""
SELECT DISTINCT qa_id, {_FLAT('question')} AS question, {_FLAT('answer')} AS answer FROM qa_records WHERE {_FLAT("coalesce(question, '')")} <> '' AND {_FLAT("coalesce(answer, '')")} <> ''""")
def model_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Pairs written as model output (prose, a fence, a JSON array) and parsed again."""
    rows = load(spark, base, "qa_records").select("qa_id", "question", "answer").distinct()
    out = F.concat(F.lit("Here they are:\n```json\n"), F.to_json(F.array(F.struct("question", "answer"), F.struct(F.lit(" ").alias("question"), F.lit("x").alias("answer")))), F.lit("\n```"))
    return rows.select("qa_id", F.explode(V.qa_pairs(out)).alias("p")).select("qa_id", "p.question", "p.answer")


@query(f"""
SELECT DISTINCT qa_id, nullif({_FLAT('question')}, '') AS from_json, nullif({_FLAT("'Which rule is ' || qa_id || '?'")}, '') AS from_line FROM qa_records WHERE {_FLAT("coalesce(question, '')")} <> ''""")
def model_questions(spark: SparkSession, base: str) -> DataFrame:
    rows = load(spark, base, "qa_records").where(T.collapse(F.coalesce("question", F.lit(""))) != "")
    line = F.concat(F.lit('\n "Which rule is '), F.col("qa_id"), F.lit('?"\nmore'))
    return rows.select("qa_id", V.question_of(F.concat(F.lit("Sure: "), F.to_json(F.struct("question")))).alias("from_json"), V.question_of(line).alias("from_line")).distinct()


@query(f"""
SELECT DISTINCT qa_id, CASE WHEN {_FLAT("coalesce(question, '')")} = '' THEN 'old' ELSE {_FLAT('question')} END AS rewritten FROM qa_records
WHERE NOT regexp_matches(coalesce(question, ''), '["''`{{}}\\\\]') AND NOT regexp_matches(lower(coalesce(question, '')), '^{WS}*(rewritten|standalone|search|retrieval|query|question)')""")
def rewrites(spark: SparkSession, base: str) -> DataFrame:
    """Questions wrapped as a model would wrap them, unwrapped again; those that hold quotes, braces or a label themselves are tested apart."""
    rows = load(spark, base, "qa_records").withColumn("q", F.coalesce("question", F.lit(""))).where(~F.col("q").rlike(r"[\"'`{}\\]") & ~F.lower("q").rlike(r"(?U)^\s*(?:rewritten|standalone|search|retrieval|query|question)"))
    return rows.select("qa_id", T.clean_rewrite(F.concat(F.lit("```\nSearch query: "), F.col("q"), F.lit("\n```")), F.lit("old")).alias("rewritten")).distinct()


@query("""
SELECT DISTINCT room_id, message_id, lower(room_id) AS token, 'webexteams://im?space=' || lower(room_id) || '&message=' || lower(message_id) AS link, '' AS broken
FROM (SELECT trim(room_id) AS room_id, trim(message_id) AS message_id FROM chat_messages) WHERE room_id <> '' AND message_id <> ''""")
def deep_links(spark: SparkSession, base: str) -> DataFrame:
    """Entity ids made of the ids, and the links that they give."""
    rows = load(spark, base, "chat_messages").select(F.trim("room_id").alias("room_id"), F.trim("message_id").alias("message_id")).where("room_id <> '' and message_id <> ''").distinct()
    entity = lambda kind, c: F.rtrim(F.translate(F.base64(F.concat(F.lit(f"scheme://us/{kind}/"), F.col(c)).cast("binary")), "+/", "-_"), F.lit("="))
    room, message = entity("ROOM", "room_id"), entity("MESSAGE", "message_id")
    return rows.select("room_id", "message_id", V.entity_token(room).alias("token"), V.message_link(room, message).alias("link"), V.message_link(F.lit("no id"), message).alias("broken"))


@query(r"""
SELECT token, n, (lower(bare) IN ('al.','approx.','art.','cf.','ch.','co.','corp.','dept.','dr.','e.g.','eq.','etc.','fig.','i.e.','inc.','jr.','mr.','mrs.','ms.','no.','p.','pg.','pp.','prof.','sec.','sr.','st.','vs.')
  OR regexp_full_match(bare, '([A-Za-z]\.){2,}')) AS short FROM (SELECT token, n, regexp_replace(token, '["'')\]}]+$', '') AS bare FROM
  (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z.]*\.["'')\]}]*')) AS token FROM documents) GROUP BY token))""")
def abbreviations(spark: SparkSession, base: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"""[A-Za-z.]*\.["')\]}]*"""), F.lit(0))
    return load(spark, base, "documents").select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).withColumn("short", T.is_abbreviation(F.col("token")))


@query(rf"""
SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(t, '(?i)^(chapter{WS}+)?\d+(\.\d+)*{WS}+[^\t-\r \x{{85}}\p{{Z}}]+') OR (len(string_split_regex(t, '{WS}+')) <= 14 AND length(t) <= 120 AND NOT ends_with(t, '.')
  AND letters > 0 AND ups >= 0.65 * letters)) AS headings
FROM (SELECT doc_id, t, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS ups FROM
  (SELECT doc_id, {_STRIP('l')} AS t FROM (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS l FROM documents WHERE text IS NOT NULL)) WHERE t <> '') GROUP BY doc_id""")
def heading_lines(spark: SparkSession, base: str) -> DataFrame:
    lines = load(spark, base, "documents").select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("l")).where(T.trim(F.col("l")) != "")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.is_heading(F.col("l"))).alias("headings"))


@query(r"""
SELECT DISTINCT room_id, CASE WHEN clean = '' THEN 'file' ELSE substring(clean, 1, 80) END AS file FROM
  (SELECT room_id, regexp_replace(regexp_replace(trim(coalesce(title, '')), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS clean FROM rooms)""")
def safe_names(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "rooms").select("room_id", T.safe_file_name(F.col("title")).alias("file")).distinct()


@query("""
SELECT event_id, CASE WHEN s IS NULL OR s < 0 THEN '' WHEN s < 1 THEN printf('%.0f ms', s * 1000) WHEN s < 60 THEN printf('%.1f s', s) ELSE printf('%dm %.1fs', floor(s / 60)::INT, s - floor(s / 60) * 60) END AS shown
FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN -1.0 ELSE (event_id % 977)::DOUBLE / 5 END AS s FROM events)""")
def answer_times(spark: SparkSession, base: str) -> DataFrame:
    """Fifths of seconds, so that no rounding hangs on the last bit."""
    s = F.when(F.col("event_id") % 50 == 0, None).when(F.col("event_id") % 50 == 1, -1.0).otherwise((F.col("event_id") % 977).cast("double") / 5)
    return load(spark, base, "events").select("event_id", T.answer_time(s).alias("shown"))


@query("""
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS product FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def dot_products(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("next")), 6).alias("product"))


_QA = f"""SELECT DISTINCT qa_id, mode, {_STRIP("CASE mode WHEN 'question_only' THEN q WHEN 'answer_only' THEN a ELSE q || chr(10) || a END")} AS text FROM
  (SELECT qa_id, 'Question: ' || {_STRIP('question')} AS q, 'Answer: ' || {_STRIP('answer')} AS a FROM qa_records WHERE question IS NOT NULL AND answer IS NOT NULL), (SELECT unnest(['question_answer', 'question_only', 'answer_only']) AS mode)"""


@query(_QA)
def qa_texts(spark: SparkSession, base: str) -> DataFrame:
    rows = load(spark, base, "qa_records").where("question is not null and answer is not null")
    out = None
    for mode in ("question_answer", "question_only", "answer_only"):
        one = rows.select("qa_id", F.lit(mode).alias("mode"), T.trim(index.qa_text(F.col("question"), F.col("answer"), mode, 0)).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


_first = lambda *keys: "coalesce(" + ", ".join(f"nullif({_FLAT(f"m['{k}']")}, '')" for k in keys) + ", '')"
_PAIR_LINES = f"""
WITH r AS (SELECT qa_id, {_FLAT("question")} AS q, lower(trim(coalesce(source_type, ''))) AS kind, metadata.chunk_metadata AS m FROM qa_records WHERE question IS NOT NULL AND answer IS NOT NULL),
p AS (SELECT *, coalesce(nullif({_STRIP("m['page_start']")}, ''), nullif({_STRIP("m['page']")}, '')) AS ps, nullif({_STRIP("m['page_end']")}, '') AS pe FROM r),
l AS (SELECT *, CASE kind WHEN 'pdf' THEN concat_ws(chr(10), 'Document: ' || {_first('pdf_title', 'title')}, 'Product: ' || {_first('product')}, 'Version: ' || {_first('doc_version')}, 'Type: ' || {_first('doc_type')},
    'Section: ' || {_first('section_path', 'section_title', 'active_heading')}, CASE WHEN ps IS NOT NULL THEN 'Pages: ' || ps || CASE WHEN pe IS NULL OR pe = ps THEN '' ELSE '-' || pe END END)
  WHEN 'webex' THEN concat_ws(chr(10), 'Room: ' || {_first('room_title', 'title')}, 'Thread: ' || {_first('thread_id')}, 'Messages: ' || {_first('message_count')}, 'Updated: ' || nullif({_first('updated_at', 'created_at')}, '')) END AS below FROM p)
SELECT DISTINCT qa_id, regexp_replace(substring({_FLAT("concat_ws(chr(10), 'Source: Synthetic QA pair' || chr(10) || 'Question: ' || q, below)")}, 1, 420), ' +$', '') AS head FROM l"""


@query(_PAIR_LINES)
def pair_prefixes(spark: SparkSession, base: str) -> DataFrame:
    """What stands before the text of a pair in the index."""
    rows = index.pair_rows(load(spark, base, "qa_records"))
    return rows.select(F.substring("chunk_id", 5, 1 << 20).alias("qa_id"), F.substring_index("retrieval_text", "\n\nQA Pair:\n", 1).alias("head")).distinct()


@query(f"""
SELECT DISTINCT qa_id, coalesce('webex::' || nullif({_STRIP("m['room_id']")}, '') || '::thread::' || nullif({_STRIP("m['thread_id']")}, ''), 'qa-link::' || nullif({_STRIP("link")}, ''),
  'doc::' || nullif({_STRIP('doc_id')}, ''), 'source::' || string_split(nullif({_STRIP('source_ref')}, ''), ':block=')[1], 'chunk::' || nullif({_STRIP('chunk_id')}, ''), 'unknown') AS bucket
FROM (SELECT qa_id, metadata.chunk_metadata AS m, CASE WHEN qa_id < '4' THEN chunk_id END AS link, CASE WHEN qa_id < '8' THEN doc_id END AS doc_id, CASE WHEN qa_id < 'c' THEN source_ref END AS source_ref, CASE WHEN qa_id < 'e' THEN chunk_id END AS chunk_id FROM qa_records)""")
def source_buckets(spark: SparkSession, base: str) -> DataFrame:
    """All branches of the cap's key: parts of the rows lack the fields that come first."""
    r = load(spark, base, "qa_records")
    has = lambda c, below: F.when(F.col("qa_id") < below, F.col(c))
    meta = F.map_concat(F.map_filter(F.col("metadata.chunk_metadata"), lambda k, _: k != "linked_chunk_id"), F.create_map(F.lit("linked_chunk_id"), has("chunk_id", "4")))
    return r.select("qa_id", retrieve.source_bucket(meta, has("doc_id", "8"), has("source_ref", "c"), has("chunk_id", "e")).alias("bucket")).distinct()


@query("""
SELECT event_id, 0.25 * value / 100 + 0.75 * (user_id % 10) / 10.0 AS plain FROM (SELECT event_id, round(value / 100, 6) * 100 AS value, user_id FROM events) WHERE value / 100 >= 0.3""")
def score_threshold(spark: SparkSession, base: str) -> DataFrame:
    """Rows below the threshold of the first score are gone before anything else."""
    e = load(spark, base, "events").select("event_id", F.round(F.col("value") / 100, 6).alias("first_score"), ((F.col("user_id") % 10) / 10.0).alias("rerank_score"))
    none = F.lit(None).cast("string")
    rows = e.withColumns({"question": F.lit("q"), "source_type": F.lit("pdf"), "source_ref": none, "metadata": F.create_map().cast("map<string,string>"), "record_type": F.lit("chunk"), "text": F.lit("x"), "retrieval_text": none})
    return retrieve.score_rows(rows, F.lit("2026-01-01").cast("timestamp"), threshold=0.3, alpha=0.75).select("event_id", F.round("score", 6).alias("plain"))


_LINE = r"^\[([^\]]*)\]\s*([^:]*):\s?(.*)$"
_MESSAGES = f"""
WITH c AS (SELECT DISTINCT chunk_id, text, coalesce({_FLAT("metadata['thread_start_text']")}, '') AS named FROM chunk_records WHERE source_type = 'webex'),
m AS (SELECT chunk_id, named, list_transform(list_filter(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x) <> ''), lambda x: CASE WHEN regexp_matches(x, '{_LINE}') THEN trim(regexp_extract(x, '{_LINE}', 3)) ELSE trim(x) END) AS said FROM c),
s AS (SELECT chunk_id, coalesce(nullif(named, ''), nullif(said[1], '')) AS seed, list_filter(said[2:], lambda x: x <> '') AS mine FROM m)
"""


@query(_MESSAGES + "SELECT DISTINCT chunk_id, seed AS question_seed, array_to_string(mine, chr(10) || chr(10)) AS answer, len(mine) AS reply_count FROM s WHERE seed IS NOT NULL AND len(mine) > 0")
def thread_answers(spark: SparkSession, base: str) -> DataFrame:
    return qa.thread_answers(load(spark, base, "chunk_records").where("source_type = 'webex'").select("chunk_id", "text", "metadata")).distinct()


@query(f"""
WITH c AS (SELECT chunk_id, lower(trim(coalesce(source_type, ''))) = 'webex' AND metadata['thread_id'] IS NOT NULL AND coalesce(TRY_CAST(metadata['message_count'] AS INT), 0) > 1 AS whole,
  coalesce(metadata['person_name'], '') || '|' || coalesce(metadata['person_email'], '') || '|' || coalesce(metadata['author'], '') AS named,
  list_transform(list_filter(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x) <> ''), lambda x: CASE WHEN regexp_matches(x, '{_LINE}') THEN lower(regexp_extract(x, '{_LINE}', 2)) ELSE '' END) AS who FROM chunk_records)
SELECT DISTINCT chunk_id FROM c WHERE CASE WHEN whole THEN len(list_filter(who[2:], lambda a: contains(a, 'member-07'))) > 0 ELSE contains(lower(named), 'member-07') OR len(list_filter(who, lambda a: contains(a, 'member-07'))) > 0 END""")
def chunk_users(spark: SparkSession, base: str) -> DataFrame:
    """Chunks that have to do with a user, by the authors of their lines or their metadata."""
    c = load(spark, base, "chunk_records")
    return c.where(generation.matches_user(F.col("source_type"), F.col("metadata"), F.col("text"), " Member-07")).select("chunk_id").distinct()


@query()
def generated_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of all chunks by the offline generator, through routing, parsing and length limits."""
    once = index.newest(load(spark, base, "chunk_records"), "chunk_id")
    pairs = generation.pair_records(generation.judged_chunks(once, PassageGenerator()))
    return pairs.select("qa_id", "chunk_id", "question", "answer", F.col("metadata.qa_generation_mode").alias("mode"))


@query("""
WITH c AS (SELECT chunk_id, any_value(source_type) AS source_type, arg_max(text, coalesce(metadata['ingested_at'], '')) AS text FROM chunk_records GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN lower(trim(source_type)) = 'webex' AND length(regexp_replace(text, '^[\\t-\\r \\x{85}\\p{Z}]+|[\\t-\\r \\x{85}\\p{Z}]+$', '', 'g')) < 200 THEN 'skipped_short_webex' ELSE 'judged' END AS step FROM c""")
def generation_steps(spark: SparkSession, base: str) -> DataFrame:
    """Which chunks are too short a chat to ask the generator about."""
    once = index.newest(load(spark, base, "chunk_records"), "chunk_id")
    done = generation.progress_rows(generation.judged_chunks(once, PassageGenerator()))
    return done.select("chunk_id", F.when(F.col("status") == "skipped_short_webex", F.col("status")).otherwise("judged").alias("step"))


@query("""
SELECT DISTINCT qa_id, 0::BIGINT AS position, 'answer ' || qa_id AS answer FROM qa_records""")
def sampled_answers(spark: SparkSession, base: str) -> DataFrame:
    """A generator that always says the same gives one candidate, however often it is asked."""

    class Same:
        def generate(self, prompt: str, seed: int = 0) -> str:
            return f"  answer {prompt} "

    prompts = load(spark, base, "qa_records").select(F.col("qa_id").alias("query"), F.col("qa_id").alias("prompt")).distinct()
    return answers.candidates(prompts, Same(), 3).select(F.col("query").alias("qa_id"), F.col("position").cast("bigint").alias("position"), "answer")


@query(r"""
WITH r AS (SELECT DISTINCT qa_id, trim(regexp_replace(coalesce(metadata.chunk_text, ''), '[\t-\r \x{85}\p{Z}]+', ' ', 'g')) AS t, list_filter(regexp_extract_all(lower(coalesce(question, '')), '[A-Za-z0-9][A-Za-z0-9._/-]*'), lambda w: length(w) >= 3) AS words FROM qa_records),
p AS (SELECT *, length(t) AS n, coalesce(list_min(list_filter(list_transform(words, lambda w: strpos(lower(t), w)), lambda i: i > 0)), 1) - 1 AS center FROM r),
s AS (SELECT *, least(n, greatest(0, center - 26) + 80) AS e FROM p)
SELECT DISTINCT qa_id, CASE WHEN n <= 80 THEN t ELSE CASE WHEN e > 80 THEN '...' ELSE '' END || trim(substring(t, greatest(0, e - 80) + 1, e - greatest(0, e - 80))) || CASE WHEN e < n THEN '...' ELSE '' END END AS snippet FROM s""")
def source_snippets(spark: SparkSession, base: str) -> DataFrame:
    rows = load(spark, base, "qa_records")
    return rows.select("qa_id", T.snippet(F.col("metadata.chunk_text"), F.col("question"), 80).alias("snippet")).distinct()
