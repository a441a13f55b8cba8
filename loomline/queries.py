"""The core queries over the test tables, and equivalent DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions import values as V
from loomline.models import HashEmbedder, OverlapScorer
from loomline.operators import chunking, qa, sections, sparse, threads
from loomline.plans import answers, budget, evaluate, feedback, index, retrieve
from loomline.session import Stage, cut, load, spread, staging
from loomline.sources import chat

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: DuckDB spellings of shared expressions.
WS = r"[\t-\r \x{85}\p{Z}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
_FLAT = lambda c: f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"
_TERMS = (
    "list_filter(flatten(list_transform(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+(?:[-_./:][A-Za-z0-9]+)*'), lambda t: lower(t)), "
    "lambda t: list_concat([t], list_filter(string_split_regex(t, '[-_./:]+'), lambda p: p <> t)))), lambda t: length(t) >= 2)"
)
_WORDS = "list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9'']+'), lambda w: lower(w)), lambda w: length(w) >= 4))"
_ISO = (
    "CASE WHEN regexp_matches(trim({c}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN TRY_CAST(CASE WHEN regexp_matches(trim({c}), '(Z|[+-]\\d{{2}}:?\\d{{2}})$') "
    "THEN trim({c}) ELSE trim({c}) || 'Z' END AS TIMESTAMPTZ) END"
)
_US = "epoch_us({c})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, {_FLAT('text')} AS flat FROM documents")
def text_normalize(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "documents").select("doc_id", T.collapse(F.col("text")).alias("flat"))


@query(rf"""
SELECT doc_id, count(*) AS paragraphs, max(length(p)) AS longest FROM (
  SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n\s*\n+'), lambda p: {_FLAT('p')}), lambda p: p <> '')) AS p FROM documents)
GROUP BY doc_id""")
def paragraph_split(spark: SparkSession, base: str) -> DataFrame:
    parts = load(spark, base, "documents").select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("p")).cast("bigint").alias("longest"))


@query(rf"""
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE greatest(len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\t-\r \x{{85}}\p{{Z}}]')), greatest(1, length(t) // 4)) END::BIGINT AS tokens
FROM (SELECT doc_id, {_STRIP("coalesce(text, '')")} AS t FROM documents)""")
def estimate_tokens(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "documents").select("doc_id", T.token_count(F.col("text")).cast("bigint").alias("tokens"))


@query(rf"""
SELECT doc_id, CASE WHEN length(t) <= 500 THEN t ELSE regexp_replace(substring(t, 1, 500 - 15), '{WS}+$', '') || chr(10) || '...[truncated]' END AS clipped
FROM (SELECT doc_id, {_STRIP("coalesce(text, '')")} AS t FROM documents)""")
def clip_text(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "documents").select("doc_id", T.clip(F.col("text"), 500).alias("clipped"))


@query()
def clip_tokens(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "documents").select("doc_id", budget.clip_tokens_column(F.col("text"), 120).alias("clipped"))


@query()
def sentence_split(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "documents").select("doc_id", F.posexplode(chunking.sentence_array(F.col("text"))).alias("pos", "sentence"))


_VECTORS = f"""
WITH terms AS (SELECT doc_id, unnest({_TERMS.format(c="coalesce(text, '')")}) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf, ('0x' || substring(md5(term), 1, 8))::BIGINT AS term_id FROM terms GROUP BY ALL),
vectors AS (SELECT doc_id, term, term_id, 1.0 + ln(tf::DOUBLE) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term_id, term) AS rn FROM counts) WHERE rn <= 512)
"""


@query(_VECTORS + "SELECT doc_id, term, term_id, round(weight, 6) AS weight FROM vectors")
def sparse_vector(spark: SparkSession, base: str) -> DataFrame:
    v = sparse.term_vectors(spread(load(spark, base, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")
    return v.withColumn("weight", F.round("weight", 6))


@query(_VECTORS + "SELECT term, count(*) AS df FROM vectors GROUP BY term")
def doc_frequency(spark: SparkSession, base: str) -> DataFrame:
    return sparse.doc_frequency(sparse.vector_lists(spread(load(spark, base, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text"))


@query(f"""
SELECT DISTINCT qa_id, CASE WHEN len(a) = 0 OR len(c) = 0 THEN 0.0 ELSE round(len(list_intersect(a, c)) / len(a), 6) END AS share
FROM (SELECT qa_id, {_WORDS.format(c="answer")} AS a, {_WORDS.format(c="metadata.chunk_text")} AS c FROM qa_records)""")
def overlap_ratio(spark: SparkSession, base: str) -> DataFrame:
    share = T.overlap_share(F.col("answer"), F.col("metadata.chunk_text"))
    return load(spark, base, "qa_records").select("qa_id", F.round(share, 6).alias("share")).distinct()


_F1 = """
WITH pairs AS (SELECT DISTINCT qa_id, question, answer FROM qa_records),
p AS (SELECT qa_id, lower(unnest(regexp_extract_all(coalesce(answer, ''), '[A-Za-z0-9'']+'))) AS w FROM pairs),
g AS (SELECT qa_id, lower(unnest(regexp_extract_all(coalesce(question, ''), '[A-Za-z0-9'']+'))) AS w FROM pairs),
pc AS (SELECT qa_id, w, count(*) AS n FROM p GROUP BY ALL), gc AS (SELECT qa_id, w, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT qa_id, sum(least(pc.n, gc.n)) AS c FROM pc JOIN gc USING (qa_id, w) GROUP BY qa_id),
f AS (SELECT x.qa_id, CASE WHEN np = 0 OR ng = 0 THEN 0.0 ELSE round(2.0 * coalesce(c, 0) / (np + ng), 6) END AS f1
  FROM (SELECT qa_id, len(regexp_extract_all(coalesce(answer, ''), '[A-Za-z0-9'']+')) AS np, len(regexp_extract_all(coalesce(question, ''), '[A-Za-z0-9'']+')) AS ng FROM pairs) x LEFT JOIN c USING (qa_id))
"""


@query(_F1 + "SELECT qa_id, f1 FROM f")
def token_f1(spark: SparkSession, base: str) -> DataFrame:
    pairs = load(spark, base, "qa_records").select("qa_id", "question", "answer").distinct()
    return evaluate.token_f1(pairs, "qa_id", "answer", "question")


@query(_F1 + "SELECT count(*) AS pairs, round(avg(f1), 6) AS mean_f1 FROM f")
def mean_token_f1(spark: SparkSession, base: str) -> DataFrame:
    return token_f1(spark, base).agg(F.count("*").alias("pairs"), F.round(F.avg("f1"), 6).alias("mean_f1"))


@query("""
SELECT doc_id, sha1(doc_id::VARCHAR || '||' || coalesce(source, '') || '||' || coalesce(title, '')) AS id,
  regexp_replace(md5(coalesce(text, '')), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM documents""")
def stable_ids(spark: SparkSession, base: str) -> DataFrame:
    d = load(spark, base, "documents")
    return d.select("doc_id", T.stable_id(F.col("doc_id"), F.col("source"), F.col("title")).alias("id"), T.md5_uuid(F.coalesce("text", F.lit(""))).alias("uuid"))


@query(f"SELECT DISTINCT message_id, created, coalesce({_US.format(c=_ISO.format(c='created'))}, -1) AS us FROM chat_messages")
def iso_parse(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "chat_messages").select("message_id", "created", F.coalesce(F.unix_micros(V.instant(F.col("created"))), F.lit(-1)).alias("us")).distinct()


@query("""
SELECT doc_id, CASE lower(trim(doc_type)) WHEN 'guide' THEN 'guide' WHEN 'guides' THEN 'guide' WHEN 'api' THEN 'api' WHEN 'reference' THEN 'api'
  WHEN 'release-note' THEN 'release-note' WHEN 'release-notes' THEN 'release-note' WHEN 'releasenote' THEN 'release-note' END AS doc_type FROM documents""")
def doc_types(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "documents").select("doc_id", V.doc_type(F.col("doc_type"), strict=False).alias("doc_type"))


_KEPT = ", ".join(f"'{k}'" for k in V.KEPT_KEYS)


@query(f"""
SELECT DISTINCT qa_id, e.key AS key, e.value AS value FROM (SELECT qa_id, unnest(map_entries(metadata.chunk_metadata)) AS e FROM qa_records) WHERE e.key IN ({_KEPT}) AND e.value IS NOT NULL AND e.value <> ''""")
def metadata_compact(spark: SparkSession, base: str) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    rows = load(spark, base, "qa_records").select("qa_id", F.explode(V.compact_metadata(F.col("metadata.chunk_metadata"), empty)))
    return rows.select("qa_id", "key", "value").distinct()


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events")
def json_extract(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "events").select("event_id", V.number(F.get_json_object(V.json_object(F.col("props")), "$.k")).alias("k"))


_BODY = f"coalesce(nullif({_STRIP('markdown')}, ''), nullif({_STRIP('text')}, ''))"
_MESSAGES = f"""
WITH m AS (SELECT nullif({_STRIP('message_id')}, '') AS message_id, nullif({_STRIP('room_id')}, '') AS room_id, nullif({_STRIP('parent_id')}, '') AS parent_id,
  coalesce(nullif({_STRIP('author')}, ''), nullif({_STRIP('person_email')}, ''), 'unknown') AS author, created, updated, {_ISO.format(c='created')} AS at_ts, {_ISO.format(c='updated')} AS edited,
  {_FLAT(_BODY)} AS body, ingested_at FROM chat_messages WHERE {_BODY} IS NOT NULL AND nullif({_STRIP('message_id')}, '') IS NOT NULL)
"""
_THREADS = _MESSAGES + """
, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY room_id, message_id ORDER BY ingested_at, body, parent_id NULLS FIRST, author, created NULLS FIRST, updated NULLS FIRST) AS rn FROM m) WHERE rn = 1),
w AS (SELECT *, message_id AS thread_id FROM once WHERE parent_id IS NULL
  UNION ALL SELECT r.*, r.parent_id FROM once r JOIN once p ON p.room_id = r.room_id AND p.message_id = r.parent_id AND p.parent_id IS NULL WHERE r.parent_id IS NOT NULL)
"""


@query(_THREADS + """
SELECT room_id, thread_id, count(*) AS messages, count(DISTINCT author) AS authors, epoch_us(min(at_ts)) AS created_us, epoch_us(max(coalesce(edited, at_ts))) AS updated_us
FROM w GROUP BY ALL HAVING count(*) >= 2""")
def thread_build(spark: SparkSession, base: str) -> DataFrame:
    t = threads.threads(load(spark, base, "chat_messages"))
    return t.select("room_id", "thread_id", F.col("message_count").alias("messages"), F.size("participants").cast("bigint").alias("authors"), F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


@query(_THREADS + """
SELECT room_id, thread_id, string_agg('[' || coalesce(nullif(trim(created), ''), 'unknown-time') || '] ' || author || ': ' || body, chr(10)
  ORDER BY message_id <> thread_id, at_ts IS NULL, at_ts, message_id) AS text FROM w GROUP BY ALL HAVING count(*) >= 2""")
def thread_texts(spark: SparkSession, base: str) -> DataFrame:
    return threads.threads(load(spark, base, "chat_messages")).select("room_id", "thread_id", "text")


@query(_THREADS + f"""
, t AS (SELECT room_id, thread_id, count(*) AS n, max(coalesce(edited, at_ts)) AS updated, string_agg('[' || coalesce(nullif(trim(created), ''), 'unknown-time') || '] ' || author || ': ' || body, chr(10) ORDER BY message_id <> thread_id, at_ts IS NULL, at_ts, message_id) AS text FROM w GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT room_id, min({_FLAT("title")}) AS title FROM rooms GROUP BY room_id)
SELECT sha1('webex::' || t.room_id || '::thread::' || thread_id) AS doc_id, 'webex::' || t.room_id || '::thread::' || thread_id AS source_ref, r.title, text, n::VARCHAR AS message_count, strftime(updated, '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM t LEFT JOIN r USING (room_id)""")
def thread_documents(spark: SparkSession, base: str) -> DataFrame:
    t = threads.thread_records(load(spark, base, "chat_messages"), load(spark, base, "rooms"))
    return t.select("doc_id", "source_ref", "title", "text", F.col("metadata")["message_count"].alias("message_count"), F.col("metadata")["updated_at"].alias("updated_at"))


@query(_MESSAGES + """
SELECT sha1('webex::' || coalesce(room_id, '') || '::message::' || message_id) AS doc_id, coalesce(parent_id, message_id) AS thread_id, author, body AS text, 1::BIGINT AS message_count FROM m""")
def message_records(spark: SparkSession, base: str) -> DataFrame:
    return threads.message_records(load(spark, base, "chat_messages")).select("doc_id", "thread_id", "author", "text", "message_count")


@query(_MESSAGES + """
SELECT room_id, string_agg(line, chr(10) ORDER BY k) AS history FROM (
  SELECT room_id, message_id || coalesce(created, '') || epoch_us(ingested_at)::VARCHAR || body AS k, CASE WHEN parent_id IS NULL THEN 'USER: ' ELSE 'ASSISTANT: ' END || body AS line,
    row_number() OVER (PARTITION BY room_id ORDER BY message_id || coalesce(created, '') || epoch_us(ingested_at)::VARCHAR || body DESC) AS rn FROM m) WHERE rn <= 4 GROUP BY room_id""")
def history_window(spark: SparkSession, base: str) -> DataFrame:
    m = threads.normal_messages(load(spark, base, "chat_messages"))
    key = F.concat("message_id", F.coalesce("created", F.lit("")), F.unix_micros("ingested_at").cast("string"), "body")
    turns = m.withColumns({"k": key, "role": F.when(F.col("parent_id").isNull(), "user").otherwise("assistant")})
    return threads.history(turns, "room_id", "k", "role", "body", 2)


@query(r"""
SELECT chunk_id, len(lines) AS lines, len(list_filter(lines, lambda x: regexp_matches(x, '^\[([^\]]*)\]\s*([^:]*):\s?(.*)$'))) AS parsed
FROM (SELECT DISTINCT chunk_id, list_filter(string_split_regex(text, '\r?\n'), lambda x: trim(x) <> '') AS lines FROM chunk_records WHERE source_type = 'webex')""")
def thread_lines(spark: SparkSession, base: str) -> DataFrame:
    rows = load(spark, base, "chunk_records").where("source_type = 'webex'").select("chunk_id", "text").distinct()
    lines = V.parse_thread(F.col("text"))
    return rows.select("chunk_id", F.size(lines).cast("bigint").alias("lines"), F.size(F.filter(lines, lambda x: x["timestamp"] != "unknown-time")).cast("bigint").alias("parsed"))


@query("""
SELECT doc_id, CASE WHEN lower(trim(source_type)) = 'webex' AND metadata['thread_id'] IS NOT NULL AND coalesce(TRY_CAST(metadata['message_count'] AS INT), 0) > 1 THEN 'thread'
  WHEN lower(trim(source_type)) = 'pdf' AND metadata['split_mode'] IN ('chapter_paragraph', 'page_paragraph', 'page_fallback') THEN 'section'
  WHEN lower(trim(source_type)) = 'pdf' THEN 'paragraphs' ELSE 'windows' END AS route FROM doc_records""")
def chunk_route(spark: SparkSession, base: str) -> DataFrame:
    return chunking.route(load(spark, base, "doc_records")).select("doc_id", "route")


def _window_end(start: str) -> str:
    """SQL: the end of a window of 1100 characters from ``start``, at its last space beyond the first third."""
    back = f"strpos(reverse(substring(t, {start} + 1, 1100)), ' ')"
    return f"CASE WHEN {start} + 1100 >= length(t) THEN length(t) WHEN {back} > 0 AND 1100 - {back} > 366 THEN {start} + 1100 - {back} ELSE {start} + 1100 END"


@query(f"""
WITH RECURSIVE t AS (SELECT doc_id, {_FLAT('text')} AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, t, 0 AS i, 0 AS s, {_window_end("0")} AS e FROM t WHERE length(t) > 0
  UNION ALL SELECT doc_id, t, i + 1, greatest(s + 1, e - 180), {_window_end("greatest(s + 1, e - 180)")} FROM w WHERE e < length(t))
SELECT doc_id, i::BIGINT AS window_no, trim(substring(t, s + 1, e - s)) AS text FROM w""")
def chunk_windows(spark: SparkSession, base: str) -> DataFrame:
    parts = chunking.window_array(T.collapse(F.col("text")), 1100, 180)
    rows = load(spark, base, "documents").where("text is not null").select("doc_id", F.posexplode(parts).alias("window_no", "text"))
    return rows.withColumn("window_no", F.col("window_no").cast("bigint"))


@query()
def chunk_pack(spark: SparkSession, base: str) -> DataFrame:
    parts = chunking.packed_array(T.paragraphs(F.col("text")), 900, 220)
    return load(spark, base, "documents").select("doc_id", F.posexplode(parts).alias("pack_no", "text"))


@query()
def chunk_documents(spark: SparkSession, base: str) -> DataFrame:
    return chunking.chunk_documents(load(spark, base, "doc_records")).select("chunk_id", "doc_id", "chunk_index", "route", "text").distinct()


_TOC_SQL = """
WITH toc AS (SELECT DISTINCT source_path AS file, page AS pos, 1 + page % 3 AS level, 'Section ' || page AS title, page FROM doc_records WHERE source_path IS NOT NULL AND page IS NOT NULL),
pages AS (SELECT file, max(page) + 2 AS page_count FROM toc GROUP BY file),
t AS (SELECT *, min(CASE WHEN level = 1 THEN 1 END) OVER (PARTITION BY file) AS top FROM toc JOIN pages USING (file)),
f AS (SELECT * FROM t WHERE top IS NULL OR level = 1),
r AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY page) AS section_no, title, page AS page_start, greatest(coalesce(lead(page) OVER (PARTITION BY file ORDER BY page) - 1, page_count), page) AS page_end FROM f)
"""


def _toc(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    d = load(spark, base, "doc_records").where("source_path is not null and page is not null").select(F.col("source_path").alias("file"), "page").distinct()
    toc = d.select("file", F.col("page").alias("pos"), (1 + F.col("page") % 3).alias("level"), F.concat(F.lit("Section "), F.col("page").cast("string")).alias("title"), "page")
    return toc, toc.groupBy("file").agg((F.max("page") + 2).alias("page_count"))


@query(_TOC_SQL + "SELECT file, section_no::BIGINT AS section_no, title, page_start, page_end FROM r")
def section_ranges(spark: SparkSession, base: str) -> DataFrame:
    return sections.section_ranges(*_toc(spark, base)).select("file", F.col("section_no").cast("bigint").alias("section_no"), "title", "page_start", "page_end")


@query(_TOC_SQL + "SELECT file, section_no::BIGINT AS section_no, unnest(generate_series(page_start, page_end))::INT AS page FROM r")
def section_pages(spark: SparkSession, base: str) -> DataFrame:
    return sections.section_pages(sections.section_ranges(*_toc(spark, base))).select("file", F.col("section_no").cast("bigint").alias("section_no"), "page")


@query()
def section_chunks(spark: SparkSession, base: str) -> DataFrame:
    ranges = sections.section_ranges(*_toc(spark, base))
    d = load(spark, base, "doc_records").where("source_path is not null").select("doc_id", F.col("source_path").alias("file"), "page", "text").distinct()
    number = F.row_number().over(Window.partitionBy("file", "page").orderBy("doc_id", "text"))
    blocks = d.select("file", "page", number.alias("block_no"), F.lit(0).alias("block_type"), "text")
    plans = sections.pack_sections(ranges, sections.page_paragraphs(blocks))
    return sections.section_records(plans, ranges).select("doc_id", "source_ref", "section_path", "page", "text", "paragraph_count", "sentence_split_count")


_JUDGE = f"""
WITH r AS (SELECT DISTINCT qa_id, {_FLAT("coalesce(question, '')")} AS q, {_FLAT("coalesce(answer, '')")} AS a, metadata.chunk_text AS c, lower(trim(metadata.qa_generation_mode)) = 'webex_thread_question_child_messages_answer' AS thread,
  question IS NULL OR answer IS NULL OR chunk_id IS NULL OR doc_id IS NULL OR source_ref IS NULL OR source_type IS NULL AS bad FROM qa_records),
x AS (SELECT *, lower(q) AS key, {_WORDS.format(c="a")} AS wa, {_WORDS.format(c="c")} AS wc FROM r),
y AS (SELECT *, length(q) < 12 AS s, length(a) < 24 OR length(a) > CASE WHEN thread THEN 300 ELSE 1800 END AS l, CASE WHEN len(wa) = 0 OR len(wc) = 0 THEN 0.0 ELSE len(list_intersect(wa, wc)) / len(wa) END < 0.08 AS weak FROM x),
f AS (SELECT key, min(qa_id) AS first FROM y WHERE NOT bad AND NOT s AND NOT l AND NOT weak GROUP BY key),
z AS (SELECT qa_id, CASE WHEN bad THEN 'invalid_schema' WHEN s THEN 'short_question' WHEN l THEN 'answer_length' WHEN qa_id > first THEN 'duplicate_question' WHEN weak THEN 'weak_grounding' ELSE 'keep' END AS reason FROM y LEFT JOIN f USING (key))
"""


@query(_JUDGE + "SELECT DISTINCT qa_id, reason FROM z")
def qa_validate(spark: SparkSession, base: str) -> DataFrame:
    ids = ("question", "answer", "chunk_id", "doc_id", "source_ref", "source_type")
    rows = load(spark, base, "qa_records").select("qa_id", *ids, F.col("metadata.chunk_text").alias("context"), F.col("metadata.qa_generation_mode").alias("mode")).distinct()
    return qa.judge(rows, "qa_id", mode="mode", required=ids, most_thread_a=300).select("qa_id", "reason").distinct()


@query(_JUDGE + "SELECT reason, count(*) AS n FROM (SELECT DISTINCT qa_id, reason FROM z) GROUP BY reason")
def qa_drop_reasons(spark: SparkSession, base: str) -> DataFrame:
    return qa_validate(spark, base).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT chunk_id FROM chunk_records c WHERE NOT EXISTS (SELECT 1 FROM qa_records q WHERE q.chunk_id = c.chunk_id)")
def resume_pending(spark: SparkSession, base: str) -> DataFrame:
    return qa.pending(load(spark, base, "chunk_records").select("chunk_id").distinct(), load(spark, base, "qa_records").where("chunk_id is not null"))


@query("SELECT DISTINCT chunk_id FROM (SELECT chunk_id FROM qa_records UNION SELECT chunk_id FROM chunk_records) WHERE chunk_id IS NOT NULL")
def processed_union(spark: SparkSession, base: str) -> DataFrame:
    return qa.processed_ids(load(spark, base, "qa_records"), load(spark, base, "chunk_records"))


@query("""
SELECT qa_id, CASE WHEN pos <= floor(n * 0.9) THEN 'train' WHEN pos <= floor(n * 0.9) + floor(n * 0.08) THEN 'valid' ELSE 'test' END AS split_name
FROM (SELECT qa_id, row_number() OVER (ORDER BY md5('42:' || qa_id), qa_id) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT qa_id FROM qa_records))""")
def split_exact(spark: SparkSession, base: str) -> DataFrame:
    return qa.exact_split(load(spark, base, "qa_records"), "qa_id")


@query(f"SELECT qa_id, {_FLAT('question')} AS said, {_FLAT('answer')} AS told, source_ref FROM qa_records")
def chat_rows(spark: SparkSession, base: str) -> DataFrame:
    m = F.col("messages")
    return qa.chat_rows(load(spark, base, "qa_records")).select("qa_id", m[0]["content"].alias("said"), m[1]["content"].alias("told"), "metadata.source_ref")


def _sql_first(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({_STRIP(f"metadata['{k}']")}, '')" for k in keys) + ", '')"


_SQL_FLAT = lambda e: _FLAT(f"coalesce({e}, '')")
_PAGES = "coalesce(CASE WHEN ps IS NULL THEN '' WHEN pe IS NULL OR ps = pe THEN ps ELSE ps || '-' || pe END, '')"
_CHUNK_INDEX = f"""
WITH c AS (SELECT *, coalesce(nullif({_STRIP("metadata['page_start']")}, ''), nullif({_STRIP("metadata['page']")}, '')) AS ps, nullif({_STRIP("metadata['page_end']")}, '') AS pe, {_STRIP('text')} AS t
  FROM chunk_records WHERE {_STRIP("coalesce(text, '')")} <> ''),
p AS (SELECT *, CASE lower(trim(source_type)) WHEN 'pdf' THEN concat_ws(chr(10), 'Document: ' || {_SQL_FLAT(_sql_first('pdf_title', 'title', 'file_name'))}, 'Product: ' || {_SQL_FLAT("metadata['product']")},
  'Version: ' || {_SQL_FLAT("metadata['doc_version']")}, 'Type: ' || {_SQL_FLAT("metadata['doc_type']")}, 'Section: ' || {_SQL_FLAT(_sql_first('section_path', 'section_title', 'active_heading'))},
  CASE WHEN {_PAGES} <> '' THEN 'Pages: ' || {_PAGES} END)
  WHEN 'webex' THEN concat_ws(chr(10), 'Source: Webex discussion', 'Room: ' || {_SQL_FLAT(_sql_first('room_title', 'title'))}, 'Thread: ' || {_SQL_FLAT("metadata['thread_id']")}, 'Messages: ' || {_SQL_FLAT("metadata['message_count']")},
  CASE WHEN {_SQL_FLAT(_sql_first('updated_at', 'created_at'))} <> '' THEN 'Updated: ' || {_SQL_FLAT(_sql_first('updated_at', 'created_at'))} END, 'Topic: ' || {_SQL_FLAT("metadata['thread_start_text']")}) ELSE '' END AS prefix FROM c),
h AS (SELECT *, regexp_replace(substring({_FLAT('prefix')}, 1, 420), '{WS}+$', '') AS head FROM p)
"""


@query(_CHUNK_INDEX + """
SELECT regexp_replace(md5(chunk_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point_id, chunk_id,
  CASE WHEN head = '' THEN t ELSE head || chr(10) || chr(10) || 'Chunk:' || chr(10) || t END AS retrieval_text FROM h""")
def index_chunks(spark: SparkSession, base: str) -> DataFrame:
    return index.chunk_rows(load(spark, base, "chunk_records")).select("point_id", "chunk_id", "retrieval_text")


@query(f"""
SELECT 'qa::' || qa_id AS chunk_id, {_STRIP(f"'Question: ' || {_STRIP('question')} || chr(10) || 'Answer: ' || CASE WHEN length({_STRIP('answer')}) > 700 THEN regexp_replace(substring({_STRIP('answer')}, 1, 700), '{WS}+$', '') ELSE {_STRIP('answer')} END")} AS text
FROM qa_records WHERE question IS NOT NULL AND answer IS NOT NULL""")
def index_pairs(spark: SparkSession, base: str) -> DataFrame:
    return index.pair_rows(load(spark, base, "qa_records")).select("chunk_id", "text")


@query("""
SELECT record_type, source_type, count(*) AS n FROM (SELECT 'chunk' AS record_type, source_type FROM chunk_records WHERE trim(coalesce(text, '')) <> ''
  UNION ALL SELECT 'qa_pair', source_type FROM qa_records WHERE question IS NOT NULL AND answer IS NOT NULL) WHERE lower(source_type) = 'pdf' GROUP BY ALL""")
def export_filter(spark: SparkSession, base: str) -> DataFrame:
    rows = index.index_rows(load(spark, base, "chunk_records"), load(spark, base, "qa_records")).where(F.lower("source_type") == "pdf")
    return rows.groupBy("record_type", "source_type").agg(F.count("*").alias("n"))


@query("""
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.text, o.text) AS text FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL) o
FULL JOIN (SELECT doc_id + 500 AS doc_id, lower(source) AS text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) n ON n.doc_id = o.doc_id""")
def upsert_latest(spark: SparkSession, base: str) -> DataFrame:
    d = load(spark, base, "documents").where("text is not null")
    new = d.where("source is not null").select((F.col("doc_id") + 500).alias("doc_id"), F.lower("source").alias("text"))
    return index.latest(d.select("doc_id", "text"), new, "doc_id")


@query("""
SELECT doc_id, arg_max(text, ingested) AS text FROM (SELECT DISTINCT doc_id, text, coalesce(metadata['ingested_at'], '') AS ingested FROM doc_records) GROUP BY doc_id""")
def latest_records(spark: SparkSession, base: str) -> DataFrame:
    d = load(spark, base, "doc_records").select("doc_id", "text", F.coalesce(F.col("metadata")["ingested_at"], F.lit("")).alias("i")).distinct()
    return d.groupBy("doc_id").agg(F.max_by("text", "i").alias("text"))


_COS = "list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])))"
_DENSE = f"""
dense AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM
  (SELECT q.vec_id AS query, p.vec_id AS doc, round({_COS.replace('a::', 'p.embedding::').replace('b::', 'q.embedding::')}, 6) AS score FROM embeddings p, embeddings q WHERE q.vec_id % 20 = 0) QUALIFY rank <= 10)
"""


def _dense(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    return retrieve.dense_topk(e, e.where("doc % 20 = 0").withColumnRenamed("doc", "query"), 10)


@query("WITH" + _DENSE + "SELECT query, doc, score, rank::BIGINT AS rank FROM dense")
def dense_topk(spark: SparkSession, base: str) -> DataFrame:
    return _dense(spark, base).select("query", "doc", "score", F.col("rank").cast("bigint").alias("rank"))


_SPARSE = _VECTORS.rstrip() + """,
n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM vectors GROUP BY term),
qv AS (SELECT doc_id AS query, term, weight * ln(1 + (n - df + 0.5) / (df + 0.5)) AS qw FROM vectors JOIN df USING (term), n WHERE doc_id % 20 = 0),
sp AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM
  (SELECT query, doc_id AS doc, round(sum(weight * qw), 6) AS score FROM vectors JOIN qv USING (term) GROUP BY ALL) QUALIFY rank <= 10)
"""


def _sparse(spark: SparkSession, base: str, k: int = 10) -> DataFrame:
    d = load(spark, base, "documents")
    with staging() as stages:
        lists = sparse.vector_lists(spread(d.select("doc_id", "text"), "doc_id"), "doc_id", "text")
        v = cut(lists.select(F.col("doc_id").alias("doc"), sparse.numbered(F.col("v")).alias("v")), "vectors")
        df = sparse.doc_frequency(v)
        q = v.where("doc % 20 = 0").withColumnRenamed("doc", "query")
        n = v.agg(F.count("*").alias("n")).scalar()
        return stages.keep(Stage(retrieve.sparse_topk(v, df, n, q, k), "ranked"))


@query(_SPARSE + "SELECT query, doc, round(score, 4) AS score, rank::BIGINT AS rank FROM sp")
def sparse_topk(spark: SparkSession, base: str) -> DataFrame:
    return _sparse(spark, base).select("query", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_SPARSE.rstrip() + "," + _DENSE.rstrip() + """
SELECT query, doc, score, rank::BIGINT AS rank FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM
  (SELECT query, doc, round(sum(w / (60.0 + rank)), 6) AS score FROM (SELECT query, doc, rank, 1.0 AS w FROM dense UNION ALL SELECT query, doc, rank, 1.5 FROM sp) GROUP BY ALL) QUALIFY rank <= 10)""")
def hybrid_rrf(spark: SparkSession, base: str) -> DataFrame:
    fused = retrieve.rrf([_dense(spark, base), _sparse(spark, base)], [1.0, 1.5], 10)
    return fused.select("query", "doc", "score", F.col("rank").cast("bigint").alias("rank"))


@query(_SPARSE + """
, b AS (SELECT query, doc, score, coalesce('source::' || nullif(trim(source), ''), 'unknown') AS bucket FROM sp JOIN documents ON doc_id = doc),
c AS (SELECT *, row_number() OVER (PARTITION BY query, bucket ORDER BY score DESC, doc) AS rn FROM b)
SELECT query, doc, rank::BIGINT AS rank FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rn > 2, score DESC, doc) AS rank FROM c) WHERE rank <= 5""")
def source_cap(spark: SparkSession, base: str) -> DataFrame:
    d = load(spark, base, "documents").select(F.col("doc_id").alias("doc"), "source")
    none = F.create_map().cast("map<string,string>")
    rows = _sparse(spark, base).drop("rank").join(d, "doc").withColumn("bucket", retrieve.source_bucket(none, F.lit(None).cast("string"), F.col("source"), F.lit(None).cast("string")))
    return retrieve.cap_sources(rows.withColumn("row_key", F.col("doc")), 2, 5).select("query", "doc", F.col("rank").cast("bigint").alias("rank"))


_NOW = "2026-01-01 00:00:00"


@query()
def search_pipeline(spark: SparkSession, base: str) -> DataFrame:
    """Evaluation questions against chunks and pairs, from index rows to capped results."""
    rows = index.index_rows(load(spark, base, "chunk_records"), load(spark, base, "qa_records"))
    rows = cut(index.with_vectors(index.newest(rows), HashEmbedder(64)), "index")
    cases = load(spark, base, "eval_cases").select(F.col("query_id").alias("query"), F.col("question").alias("search")).distinct()
    found = retrieve.search(rows, cases, F.lit(_NOW).cast("timestamp"), HashEmbedder(64), fetch=40, k=10, most_per_source=4, scorers=(OverlapScorer(),), pair_boost=0.01)
    line = T.source_line(V.source_kind(F.col("source_type"), F.col("metadata"), F.col("source_ref")), F.col("source_ref"), F.col("record_type"), F.col("metadata"), F.col("score"), F.col("first_score"))
    why = T.score_explanation(F.col("score"), F.col("first_score"), F.col("rerank_score"), F.col("recency.bonus"))
    return found.select("query", "rank", "chunk_id", "score", line.alias("line"), why.alias("why"))


@query(f"""
WITH r AS (SELECT DISTINCT qa_id, lower({_FLAT('question')}) AS q, lower(trim(coalesce(source_type, ''))) AS st, source_ref, metadata.chunk_metadata AS m FROM qa_records WHERE question IS NOT NULL),
k AS (SELECT *, CASE WHEN st <> '' THEN st WHEN nullif(trim(m['source_type']), '') IS NOT NULL THEN lower(trim(m['source_type'])) WHEN lower(source_ref) LIKE 'webex::%' THEN 'webex' WHEN lower(source_ref) LIKE 'pdf::%' THEN 'pdf' ELSE '' END AS kind,
  coalesce({_ISO.format(c="m['updated_at']")}, {_ISO.format(c="m['created_at']")}, {_ISO.format(c="m['ingested_at']")}) AS at_ts,
  {" OR ".join(f"contains(q, '{w}')" for w in T.RECENT)} AS recent FROM r),
a AS (SELECT *, greatest(0.0, (epoch_us(TIMESTAMPTZ '{_NOW}+00') - epoch_us(at_ts)) / 86400000000.0) AS age FROM k)
SELECT qa_id, round(0.35 * 0.5 + 0.65 * 0.25 + 0.02 + CASE WHEN kind = 'webex' AND at_ts IS NOT NULL THEN (CASE WHEN recent THEN 0.1 ELSE 0.04 END) * exp(-ln(2.0) * age / CASE WHEN recent THEN 14.0 ELSE 45.0 END) ELSE 0 END, 6) AS score FROM a""")
def score_recency(spark: SparkSession, base: str) -> DataFrame:
    r = load(spark, base, "qa_records").where("question is not null").select(
        "qa_id", "question", "source_type", "source_ref", F.col("metadata.chunk_metadata").alias("metadata"), F.lit("qa_pair").alias("record_type"), F.lit(0.5).alias("first_score"),
        F.lit(0.25).alias("rerank_score"), F.col("qa_id").alias("text"), F.lit(None).cast("string").alias("retrieval_text"),
    )
    scored = retrieve.score_rows(r, F.lit(_NOW).cast("timestamp"), alpha=0.65, pair_boost=0.02)
    return scored.select("qa_id", "score").distinct()


@query()
def context_budget(spark: SparkSession, base: str) -> DataFrame:
    text = T.clip(F.col("text"), 800)  # as the budget cuts it, but before texts cross the network
    d = load(spark, base, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("source_ref"), text.alias("text"))
    ranked = _sparse(spark, base).join(d, "doc").select("query", "rank", "source_ref", "text")
    return budget.select_context(ranked, rows=6, chunk_chars=800, total_chars=2400, total_tokens=500)


@query()
def prompts(spark: SparkSession, base: str) -> DataFrame:
    c = budget.format_context(context_budget(spark, base))
    return c.select("query", budget.prompt(F.concat(F.lit("What does document "), F.col("query").cast("string"), F.lit(" say?")), F.col("context"), F.lit("")).alias("prompt"))


_ANSWERS = f"""
WITH r AS (SELECT chunk_id AS query, qa_id, answer, {_WORDS.format(c="answer")} AS a, {_WORDS.format(c="question")} AS q, {_WORDS.format(c="metadata.chunk_text")} AS c,
  row_number() OVER (PARTITION BY chunk_id ORDER BY qa_id) - 1 AS position FROM (SELECT DISTINCT chunk_id, qa_id, question, answer, metadata FROM qa_records WHERE chunk_id IS NOT NULL)),
s AS (SELECT *, CASE WHEN len(a) = 0 OR len(q) = 0 THEN 0.0 ELSE len(list_intersect(a, q)) / len(a) END AS rel, CASE WHEN len(a) = 0 OR len(c) = 0 THEN 0.0 ELSE len(list_intersect(a, c)) / len(a) END AS sup, count(*) OVER (PARTITION BY query) AS n FROM r),
t AS (SELECT *, CASE WHEN n <= 1 THEN 0.0 ELSE round(0.3 * rel + 0.7 * sup, 6) END AS score FROM s)
"""


def _answers(spark: SparkSession, base: str) -> DataFrame:
    r = load(spark, base, "qa_records").where("chunk_id is not null").select(F.col("chunk_id").alias("query"), "qa_id", "question", "answer", F.col("metadata.chunk_text").alias("c")).distinct()
    r = r.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("qa_id")) - 1)
    r = r.select("query", "qa_id", "position", "answer", T.overlap_share(F.col("answer"), F.col("question")).alias("relevance"), T.overlap_share(F.col("answer"), F.col("c")).alias("support"))
    return answers.rank_answers(r, 0.7)


@query(_ANSWERS + "SELECT query, qa_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, position)::BIGINT AS rank FROM t")
def answer_rank(spark: SparkSession, base: str) -> DataFrame:
    return _answers(spark, base).select("query", "qa_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(_ANSWERS + "SELECT query, qa_id FROM (SELECT query, qa_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, position) AS rn FROM t) WHERE rn = 1")
def answer_best(spark: SparkSession, base: str) -> DataFrame:
    return answers.best_answers(_answers(spark, base), "qa_id")


_CASE_SEARCH = f"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunk_records), once AS (SELECT chunk_id, min(text) AS text FROM c GROUP BY chunk_id),
ct AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_TERMS.format(c="coalesce(text, '')")}) AS term FROM once) GROUP BY ALL),
cv AS (SELECT chunk_id, term, 1.0 + ln(tf::DOUBLE) AS weight FROM ct), n AS (SELECT count(*) AS n FROM once), df AS (SELECT term, count(*) AS df FROM cv GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_TERMS.format(c="gold_passage")}) AS term FROM eval_cases) GROUP BY ALL),
qv AS (SELECT query_id, term, (1.0 + ln(tf::DOUBLE)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS qw FROM qt JOIN df USING (term), n),
hits AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
  (SELECT query_id, chunk_id, round(sum(weight * qw), 6) AS score FROM cv JOIN qv USING (term) GROUP BY ALL) QUALIFY rank <= 10),
best AS (SELECT e.query_id, min(CASE WHEN list_contains(e.expected_chunk_ids, h.chunk_id) THEN h.rank END) AS best_rank FROM eval_cases e LEFT JOIN hits h USING (query_id)
  WHERE len(coalesce(e.expected_chunk_ids, [])) > 0 OR len(coalesce(e.expected_source_refs, [])) > 0 GROUP BY ALL)
"""


def _case_rows(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    once = load(spark, base, "chunk_records").groupBy("chunk_id").agg(F.min("text").alias("text"))
    v = cut(sparse.vector_lists(once, "chunk_id", "text", 0).withColumnRenamed("chunk_id", "doc"), "vectors")
    cases = load(spark, base, "eval_cases")
    q = sparse.vector_lists(cases.select(F.col("query_id").alias("query"), "gold_passage"), "query", "gold_passage", 0)
    found = retrieve.sparse_topk(v, sparse.doc_frequency(v), v.agg(F.count("*").alias("n")).scalar(), q, 10)
    rows = found.select("query", "rank", "score", F.lit(None).cast("string").alias("source_ref"), F.col("doc").alias("chunk_id"), F.lit(None).cast("string").alias("linked_chunk_id"))
    return rows, evaluate.load_cases(cases)


def _best_ranks(spark: SparkSession, base: str) -> DataFrame:
    return evaluate.best_ranks(*_case_rows(spark, base))


@query(_CASE_SEARCH + "SELECT query_id AS query, coalesce(best_rank, 0)::BIGINT AS best_rank FROM best")
def eval_best_rank(spark: SparkSession, base: str) -> DataFrame:
    return _best_ranks(spark, base).select("query", F.coalesce("best_rank", F.lit(0)).cast("bigint").alias("best_rank"))


@query(_CASE_SEARCH + """
SELECT e.query_id AS query, b.best_rank::BIGINT AS match_rank, coalesce(b.best_rank <= 5, false) AS hit_at_k, coalesce(t.n, 0) AS rows, t.first AS first_chunk FROM (SELECT DISTINCT query_id FROM eval_cases) e LEFT JOIN best b USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n, min(CASE WHEN rank = 1 THEN chunk_id END) AS first FROM hits WHERE rank <= 5 GROUP BY query_id) t USING (query_id)""")
def eval_case_reports(spark: SparkSession, base: str) -> DataFrame:
    rows, cases = _case_rows(spark, base)
    r = evaluate.case_reports(rows, cases, 5)
    return r.select("query", F.col("match_rank").cast("bigint").alias("match_rank"), "hit_at_k", F.size("top_rows").cast("bigint").alias("rows"), F.get("top_rows", F.lit(0))["chunk_id"].alias("first_chunk"))


@query(_CASE_SEARCH + """
SELECT count(*) AS labelled, round(avg(CASE WHEN best_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN best_rank <= 10 THEN 1.0 / best_rank ELSE 0.0 END), 6) AS mrr FROM best""")
def eval_recall_mrr(spark: SparkSession, base: str) -> DataFrame:
    return evaluate.recall_mrr(_best_ranks(spark, base), 10)


@query(f"""
WITH a AS (SELECT answerable, {" OR ".join(f"contains(lower(gold_passage), '{w.replace("'", "''")}')" for w in T.ABSTAIN)} OR trim(gold_passage) = '' AS ab, expected_answer_contains AS ph, length(gold_passage) / 100.0 AS s,
  len(list_filter(expected_answer_contains, lambda p: contains(lower(gold_passage), lower(p)))) AS hit FROM eval_cases)
SELECT count(*) AS cases, round(avg(CASE WHEN answerable THEN ab::INT END), 6) AS abstain_answerable, round(avg(CASE WHEN NOT answerable THEN ab::INT END), 6) AS abstain_unanswerable,
  round(avg(CASE WHEN answerable IS NULL THEN ab::INT END), 6) AS abstain_unlabelled, round(avg(CASE WHEN len(ph) > 0 THEN (hit = len(ph))::INT END), 6) AS phrase_full_hit, round(avg(s), 6) AS mean_seconds FROM a""")
def eval_answers(spark: SparkSession, base: str) -> DataFrame:
    c = load(spark, base, "eval_cases")
    rows = c.select(F.col("query_id").alias("query"), F.col("gold_passage").alias("answer"), F.col("expected_answer_contains").alias("phrases"), "answerable", (F.length("gold_passage") / 100.0).alias("seconds"))
    return evaluate.answer_report(rows)


@query(f"""
SELECT room_id, title, room_type FROM (SELECT room_id, title, room_type, row_number() OVER (PARTITION BY room_id ORDER BY title, room_type) AS rn FROM
  (SELECT trim(room_id) AS room_id, {_FLAT('title')} AS title, lower(trim(room_type)) AS room_type FROM rooms)) WHERE rn = 1 AND room_type = 'group'""")
def room_list(spark: SparkSession, base: str) -> DataFrame:
    return chat.rooms_of(load(spark, base, "rooms"), "group")


@query(r"""
WITH r AS (SELECT room_id, min(title) AS title FROM (SELECT trim(room_id) AS room_id, trim(regexp_replace(title, '[\t-\r \x{85}\p{Z}]+', ' ', 'g')) AS title FROM rooms) WHERE room_id <> '' GROUP BY room_id),
s AS (SELECT room_id, regexp_replace(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS c FROM r),
b AS (SELECT room_id, CASE WHEN c = '' THEN 'file' ELSE substring(c, 1, 80) END AS b FROM s)
SELECT room_id, CASE WHEN row_number() OVER (PARTITION BY lower(b) ORDER BY room_id) = 1 THEN b ELSE substring(b, 1, 71) || '_' || substring(sha1(room_id), 1, 8) END AS base_name FROM b""")
def room_files(spark: SparkSession, base: str) -> DataFrame:
    return chat.file_names(chat.rooms_of(load(spark, base, "rooms"))).select("room_id", "base_name")


@query(_MESSAGES + """
SELECT message_id, room_id FROM (SELECT DISTINCT message_id, room_id, at_ts FROM m) WHERE at_ts >= TIMESTAMPTZ '2024-05-01 00:00:00+00' AND at_ts < TIMESTAMPTZ '2024-06-12 00:00:00+00'""")
def fetch_window(spark: SparkSession, base: str) -> DataFrame:
    m = threads.normal_messages(load(spark, base, "chat_messages")).select("message_id", "room_id", F.col("at").alias("created_at")).distinct()
    return chat.apply_policy(m, chat.fetch_policy("01052024-11062024")).select("message_id", "room_id")


@query("""
SELECT event_id::VARCHAR AS message_id, CASE WHEN value > 50 THEN 'up' ELSE 'down' END AS rating, event_type AS question, round(value / 10, 6) AS answer_time_seconds, 1::BIGINT AS sources FROM events""")
def feedback_rows(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "events")
    source = F.struct(*[F.lit("x").alias(c) for c in ("source_ref", "chunk_id", "doc_id", "source_type", "record_type")], *[F.col("value").alias(c) for c in ("score", "first_score", "rerank_score")])
    rows = e.select(F.col("event_id").cast("string").alias("message_id"), F.when(F.col("value") > 50, "up").otherwise("down").alias("rating"), F.lit("").alias("feedback_text"), F.col("event_type").alias("question"), F.lit("").alias("answer"), F.lit("").alias("retrieval_query"), (F.col("value") / 10).alias("answer_time_seconds"), F.array(source).alias("sources"))
    out = feedback.feedback_rows(rows, F.lit(_NOW).cast("timestamp"))
    return out.select("message_id", "rating", "question", F.round("answer_time_seconds", 6).alias("answer_time_seconds"), F.size("selected_sources").cast("bigint").alias("sources"))


from loomline import queries_more  # noqa: E402

QUERIES.update(queries_more.QUERIES)
ORACLE.update(queries_more.ORACLE)
