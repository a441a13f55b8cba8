"""The queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import bpe, conversations, defects, groups, leakage, overlap, pii, residue, scans, splitting
from loomline.session import load


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return groups.found_groups(load(spark, base, "qa_records"))


def p1_splits(spark: SparkSession, base: str) -> DataFrame:
    return groups.assign_splits(load(spark, base, "qa_records"), load(spark, base, "split_targets"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return overlap.found_overlaps(load(spark, base, "qa_records"), load(spark, base, "qa_splits"))


def p2_counts(spark: SparkSession, base: str) -> DataFrame:
    return overlap.overlap_counts(load(spark, base, "qa_records"), load(spark, base, "qa_splits"))


def p2_coverage(spark: SparkSession, base: str) -> DataFrame:
    return overlap.coverage(load(spark, base, "qa_records"), load(spark, base, "qa_splits"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return defects.find_defects(load(spark, base, "qa_records"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return pii.found_pii(load(spark, base, "chunk_records"), load(spark, base, "qa_records"))


def p3_redacted(spark: SparkSession, base: str) -> DataFrame:
    chunks = pii.redacted(load(spark, base, "chunk_records"), "chunk_id", "text")
    answers = pii.redacted(load(spark, base, "qa_records"), "qa_id", "answer")
    return chunks.selectExpr("'chunk' AS record_kind", "*").unionByName(answers.selectExpr("'qa' AS record_kind", "*"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return scans.found_noise(load(spark, base, "doc_records"))


def p5_repaired(spark: SparkSession, base: str) -> DataFrame:
    return scans.repaired(load(spark, base, "doc_records")).select("doc_id", "text", "markdown").distinct()


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    found = conversations.conversations(load(spark, base, "chat_messages"), extra=())
    return found.select("thread_id", "turn_no", "message_id")


def p6_conversations(spark: SparkSession, base: str) -> DataFrame:
    return conversations.conversations(load(spark, base, "chat_messages"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    tables = [load(spark, base, t) for t in ("doc_records", "chunk_records", "size_limits")]
    return splitting.found_oversized(*tables)


def p7_pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.split_tables(*[load(spark, base, t) for t in ("doc_records", "chunk_records", "size_limits")])


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return bpe.encode_corpus(load(spark, base, "documents"), unique_ids=True)


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    found = leakage.find_leaks(load(spark, base, "documents"), load(spark, base, "eval_cases"))
    return found.select("doc_id", "query_id")


def p9_leaks(spark: SparkSession, base: str) -> DataFrame:
    """Exact and proximity matches, with the longest run of each."""
    return leakage.find_leaks(load(spark, base, "documents"), load(spark, base, "eval_cases"), slack=3)


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return residue.find_residue(load(spark, base, "documents"))


def p10_corpus(spark: SparkSession, base: str) -> DataFrame:
    return residue.without_residue(load(spark, base, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_splits, p2_found, p2_counts, p2_coverage, p3_found, p3_redacted, p4_found, p5_found, p5_repaired, p6_found, p6_conversations, p7_found, p7_pieces, p8_ids, p9_found, p9_leaks, p10_found, p10_corpus)
}

_WS = r"[\t-\r \x{85}\p{Z}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_ID = lambda c: f"nullif(lower({_STRIP(c)}), '')"
_WORDS = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
_INSTANT = lambda c: (
    f"CASE WHEN regexp_matches({_STRIP(c)}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN TRY_CAST(CASE WHEN regexp_matches({_STRIP(c)}, '(Z|[+-]\\d{{2}}:?\\d{{2}})$') "
    f"THEN {_STRIP(c)} ELSE {_STRIP(c)} || 'Z' END AS TIMESTAMPTZ) END"
)
_LABEL = "CASE lower(" + _STRIP("split_name") + ") " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in overlap.LABELS.items()) + " END"

#: SQL over whole tables, where it is fast enough. p8_ids and the text problems are tested against the tokenizer library,
#: brute force and planted cases instead.
ORACLE: dict[str, str] = {
    "p1_found": f"""
WITH RECURSIVE r AS (SELECT DISTINCT qa_id, 'c:' || {_ID("chunk_id")} AS c, 'd:' || {_ID("doc_id")} AS d FROM qa_records),
l AS (SELECT 'q:' || qa_id AS a, c AS b FROM r WHERE c IS NOT NULL UNION SELECT 'q:' || qa_id, d FROM r WHERE d IS NOT NULL),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT DISTINCT a AS s, a AS n FROM l WHERE a LIKE 'q:%' UNION SELECT s, e.b FROM reach JOIN e ON e.a = reach.n)
SELECT substring(s, 3) AS qa_id, min(CASE WHEN n LIKE 'd:%' THEN substring(n, 3) END) AS group_doc_id FROM reach GROUP BY s HAVING count(CASE WHEN n LIKE 'q:%' THEN 1 END) > 1""",
    "p2_found": f"""
WITH l AS (SELECT DISTINCT qa_id, {_LABEL} AS label FROM qa_splits), r AS (SELECT DISTINCT qa_id, label, list_distinct({_WORDS("question")}) AS q, list_distinct({_WORDS("answer")}) AS a FROM qa_records JOIN l USING (qa_id) WHERE label IS NOT NULL),
p AS (SELECT t.qa_id AS t, e.qa_id AS e, len(list_intersect(t.q, e.q)) AS qi, len(t.q) + len(e.q) AS qn, len(list_intersect(t.a, e.a)) AS ai, len(t.a) + len(e.a) AS an FROM r t, r e WHERE t.label = 'train' AND e.label <> 'train' AND t.qa_id <> e.qa_id)
SELECT DISTINCT least(t, e) AS qa_id_a, greatest(t, e) AS qa_id_b FROM p WHERE (qn = 0 OR qi >= 0.7 * (qn - qi) - 1e-9) AND (an = 0 OR ai >= 0.7 * (an - ai) - 1e-9)""",
    "p6_found": f"""
WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edited DESC NULLS LAST, ingested_at DESC) AS rn FROM
  (SELECT nullif({_STRIP("message_id")}, '') AS id, nullif({_STRIP("parent_id")}, '') AS parent, nullif({_STRIP("thread_id")}, '') AS thread, lower({_STRIP("coalesce(author, '')")}) AS who,
    coalesce(regexp_matches(lower(person_email), '@bot\\.example\\s*$'), false) AS bot, {_INSTANT("created")} AS made, {_INSTANT("updated")} AS edited, ingested_at,
    text IS NOT NULL AND NOT regexp_matches(text, '^[\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]*$') AND lower(trim(text)) NOT IN ('(deleted)', '<removed>', '[message removed]', 'this message was deleted.', 'message deleted by its author') AS ok FROM chat_messages) WHERE id IS NOT NULL),
o AS (SELECT * FROM m WHERE rn = 1),
w AS (SELECT id, id AS at_id, coalesce(thread, CASE WHEN parent IS NULL THEN id END) AS named, parent FROM o
  UNION ALL SELECT w.id, o.id, coalesce(o.thread, CASE WHEN o.parent IS NULL THEN o.id END), o.parent FROM w JOIN o ON o.id = w.parent WHERE w.named IS NULL),
z AS (SELECT id, coalesce(max(named), max(CASE WHEN named IS NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.id = w.parent) THEN parent END), id) AS th FROM w GROUP BY id),
t AS (SELECT o.*, z.th FROM o JOIN z USING (id)),
k AS (SELECT t.th FROM t JOIN t s ON s.id = t.th AND s.th = t.th WHERE s.ok GROUP BY t.th, s.who HAVING bool_or(t.ok AND t.who <> s.who AND NOT t.bot) AND bool_and(t.parent IS NULL OR EXISTS (SELECT 1 FROM o WHERE o.id = t.parent)))
SELECT th AS thread_id, row_number() OVER (PARTITION BY th ORDER BY id <> th, made IS NULL, made, id) AS turn_no, id AS message_id FROM t JOIN k USING (th) WHERE ok""",
    "p6_conversations": f"""
WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edited DESC NULLS LAST, ingested_at DESC) AS rn FROM
  (SELECT nullif({_STRIP("message_id")}, '') AS id, nullif({_STRIP("parent_id")}, '') AS parent, nullif({_STRIP("thread_id")}, '') AS thread, lower({_STRIP("coalesce(author, '')")}) AS who,
    coalesce(regexp_matches(lower(person_email), '@bot\\.example\\s*$'), false) AS bot, {_INSTANT("created")} AS made, author, created, text, {_INSTANT("updated")} AS edited, ingested_at,
    text IS NOT NULL AND NOT regexp_matches(text, '^[\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]*$') AND lower(trim(text)) NOT IN ('(deleted)', '<removed>', '[message removed]', 'this message was deleted.', 'message deleted by its author') AS ok FROM chat_messages) WHERE id IS NOT NULL),
o AS (SELECT * FROM m WHERE rn = 1),
w AS (SELECT id, id AS at_id, coalesce(thread, CASE WHEN parent IS NULL THEN id END) AS named, parent FROM o
  UNION ALL SELECT w.id, o.id, coalesce(o.thread, CASE WHEN o.parent IS NULL THEN o.id END), o.parent FROM w JOIN o ON o.id = w.parent WHERE w.named IS NULL),
z AS (SELECT id, coalesce(max(named), max(CASE WHEN named IS NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.id = w.parent) THEN parent END), id) AS th FROM w GROUP BY id),
t AS (SELECT o.*, z.th FROM o JOIN z USING (id)),
k AS (SELECT t.th, s.who AS starter FROM t JOIN t s ON s.id = t.th AND s.th = t.th WHERE s.ok GROUP BY t.th, s.who HAVING bool_or(t.ok AND t.who <> s.who AND NOT t.bot) AND bool_and(t.parent IS NULL OR EXISTS (SELECT 1 FROM o WHERE o.id = t.parent)))
SELECT th AS thread_id, row_number() OVER (PARTITION BY th ORDER BY id <> th, made IS NULL, made, id) AS turn_no, id AS message_id, CASE WHEN bot THEN 'system' WHEN who = starter THEN 'user' ELSE 'assistant' END AS role, author, created, text FROM t JOIN k USING (th) WHERE ok""",
    "p2_counts": f"""
WITH l AS (SELECT DISTINCT qa_id, {_LABEL} AS label FROM qa_splits), r AS (SELECT DISTINCT qa_id, label, lower({_STRIP("source_type")}) AS source, list_distinct({_WORDS("question")}) AS q, list_distinct({_WORDS("answer")}) AS a FROM qa_records JOIN l USING (qa_id) WHERE label IS NOT NULL),
p AS (SELECT t.qa_id AS t, e.qa_id AS e, e.label AS split_name, e.source AS source_type, len(list_intersect(t.q, e.q)) AS qi, len(t.q) + len(e.q) AS qn, len(list_intersect(t.a, e.a)) AS ai, len(t.a) + len(e.a) AS an FROM r t, r e WHERE t.label = 'train' AND e.label <> 'train' AND t.qa_id <> e.qa_id)
SELECT split_name, source_type, count(DISTINCT e) AS records, count(DISTINCT (e, t)) AS pairs FROM p WHERE (qn = 0 OR qi >= 0.7 * (qn - qi) - 1e-9) AND (an = 0 OR ai >= 0.7 * (an - ai) - 1e-9) GROUP BY ALL""",
    "p7_found": """
SELECT DISTINCT 'document' AS record_kind, doc_id AS record_id FROM doc_records, size_limits WHERE record_kind = 'document' AND length(text) > max_chars
UNION SELECT DISTINCT 'chunk', chunk_id FROM chunk_records, size_limits WHERE record_kind = 'chunk' AND length(text) > max_chars""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_WORDS("text")} AS w FROM documents), e AS (SELECT query_id, {_WORDS("gold_passage")} AS w FROM eval_cases),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM d)),
eg AS (SELECT DISTINCT query_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT query_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM e))
SELECT DISTINCT doc_id, query_id FROM dg JOIN eg USING (g)""",
}
