"""Dates, JSON, maps, numbers and encodings as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import blank_to_null, collapse, trim

#: Spellings of document types.
DOC_TYPES = {
    "guide": "guide", "guides": "guide", "api": "api", "reference": "api", "release-note": "release-note", "release-notes": "release-note",
    "releasenote": "release-note",
}
#: Chunk metadata kept with a pair.
KEPT_KEYS = (
    "title", "product", "doc_version", "doc_type", "pdf_title", "section_title", "section_path", "active_heading", "page", "page_start", "page_end", "room_id",
    "room_title", "thread_id", "message_count", "webex_parent_message_link", "created_at", "updated_at", "ingested_at",
)


def instant(text: Column) -> Column:
    """ISO text as a timestamp, UTC if it names no zone; null for anything else."""
    t = trim(text)
    zoned = t.rlike(r"(?i)[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$")
    timed = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    whole = F.when(zoned, t).when(timed, F.concat(t, F.lit("Z"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z")))
    return whole.try_cast("timestamp")


def utc_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pdf_date(text: Column) -> Column:
    """``D:YYYY[MM[DD[HH[mm[SS]]]]]`` as a timestamp, missing parts at their least; null if invalid."""
    pattern = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    part = lambda i, least: F.coalesce(F.nullif(F.regexp_extract(trim(text), pattern, i), F.lit("")), F.lit(least))
    iso = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), F.lit("Z"))
    return iso.try_cast("timestamp")


def compact_date(text: Column) -> Column:
    """ddmmyyyy as a date, null if invalid."""
    t = trim(text)
    return F.when(t.rlike(r"^\d{8}$"), F.concat(F.substring(t, 5, 4), F.lit("-"), F.substring(t, 3, 2), F.lit("-"), F.substring(t, 1, 2))).try_cast("date")


def display_time(text: Column) -> Column:
    """A readable time; what cannot be read comes out as it is."""
    return F.coalesce(F.date_format(instant(text), "yyyy-MM-dd HH:mm"), text)


def json_object(text: Column) -> Column:
    """From the first { to the last }, if that is a JSON object; else null."""
    blob = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(blob).isNotNull(), blob)


def qa_pairs(text: Column) -> Column:
    """Question-answer pairs of a JSON array in model output; both must be texts that are not blank."""
    blob = F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))
    pairs = F.from_json(F.when(F.try_parse_json(blob).isNotNull(), blob), "array<struct<question:string,answer:string>>")
    clean = F.transform(pairs, lambda p: F.struct(collapse(p["question"]).alias("question"), collapse(p["answer"]).alias("answer")))
    return F.coalesce(F.filter(clean, lambda p: (p["question"] != "") & (p["answer"] != "")), F.array().cast("array<struct<question:string,answer:string>>"))


def question_of(text: Column) -> Column:
    """The question of model output: a JSON field, else the first line that is not blank, without quotes."""
    field = blank_to_null(F.get_json_object(json_object(text), "$.question"))
    line = F.get(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(trim(x), r"""^["']+|["']+$""", "")), lambda x: x != ""), F.lit(0))
    return F.coalesce(collapse(field), collapse(line))


def entity_token(entity: Column) -> Column:
    """The last path part, lower case, of a base64url-encoded entity URI; null if it is none."""
    padded = F.translate(trim(entity), "-_", "+/")
    padded = F.rpad(padded, (F.ceil(F.length(padded) / 4) * 4).cast("int"), F.lit("="))
    uri = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(uri.contains("://"), F.lower(F.element_at(F.split(uri, "/"), -1)))


def message_link(room: Column, message: Column) -> Column:
    """A deep link to a message of a space; empty if either token is missing."""
    r, m = entity_token(room), entity_token(message)
    return F.coalesce(F.concat(F.lit("webexteams://im?space="), r, F.lit("&message="), m), F.lit(""))


def doc_type(text: Column, strict: bool = True) -> Column:
    """The canonical document type; null for blank. strict: anything unknown is an error, else null."""
    key = F.lower(blank_to_null(text))
    out = None
    for spelling, name in DOC_TYPES.items():
        out = F.when(key == spelling, name) if out is None else out.when(key == spelling, name)
    if strict:
        out = out.when(key.isNotNull(), F.raise_error(F.lit("doc_type must be one of: guide, api, release-note")))
    return out


def without_nulls(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


def overlay(base: Column, *over: Column) -> Column:
    """One map of several; later ones win. Independent of spark.sql.mapKeyDedupPolicy."""
    out = F.coalesce(base, F.create_map().cast("map<string,string>"))
    for top in over:
        out = F.map_concat(_without_keys(out, top), top)
    return out


def _without_keys(base: Column, top: Column) -> Column:
    return F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k))


def compact_metadata(chunk_metadata: Column, own: Column) -> Column:
    """The kept keys of a chunk's metadata that say something, overlaid by a pair's own."""
    kept = F.map_filter(chunk_metadata, lambda k, v: k.isin(*KEPT_KEYS) & v.isNotNull() & (v != ""))
    return overlay(F.coalesce(kept, F.create_map().cast("map<string,string>")), own)


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def decay(age_days: Column, half_life: Column | float) -> Column:
    half_life = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.exp(-F.log(F.lit(2.0)) * age_days / half_life)


def number(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def thread_line(author: Column, text: Column, created: Column) -> Column:
    """``[time] author: text`` on one line."""
    who = F.coalesce(blank_to_null(author), F.lit("unknown-user"))
    when = F.coalesce(blank_to_null(created), F.lit("unknown-time"))
    return F.concat(F.lit("["), when, F.lit("] "), who, F.lit(": "), collapse(F.coalesce(text, F.lit(""))))


LINE = r"^\[([^\]]*)\]\s*([^:]*):\s?(.*)$"


def parse_thread_line(line: Column) -> Column:
    """struct(timestamp, author, message_text); lines of another form are texts of an unknown author and time."""
    ok = line.rlike(LINE)
    part = lambda i, default: F.coalesce(F.nullif(F.trim(F.regexp_extract(line, LINE, i)), F.lit("")), F.lit(default))
    return F.struct(
        F.when(ok, part(1, "unknown-time")).otherwise("unknown-time").alias("timestamp"),
        F.when(ok, part(2, "unknown-user")).otherwise("unknown-user").alias("author"),
        F.when(ok, F.trim(F.regexp_extract(line, LINE, 3))).otherwise(F.trim(line)).alias("message_text"),
    )


def parse_thread(text: Column) -> Column:
    """The parsed lines of a thread, blank ones dropped."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: parse_thread_line(x))


def source_kind(source_type: Column, metadata: Column, source_ref: Column) -> Column:
    """The source type: column, else metadata, else prefix of the reference, else ''."""
    ref = F.lower(trim(F.coalesce(source_ref, F.lit(""))))
    return F.coalesce(
        F.lower(blank_to_null(source_type)), F.lower(blank_to_null(metadata["source_type"])),
        F.when(ref.startswith("webex::"), "webex").when(ref.startswith("pdf::"), "pdf").otherwise(""),
    )


def preferred_time(metadata: Column, preferred: str = "updated_at") -> Column:
    """struct(at, field): the first readable of the preferred field, updated_at, created_at, ingested_at."""
    fields = list(dict.fromkeys((preferred, "updated_at", "created_at", "ingested_at")))
    times = F.transform(F.array(*[F.struct(metadata[f].alias("text"), F.lit(f).alias("field")) for f in fields]), lambda x: F.struct(instant(x["text"]).alias("at"), x["field"].alias("field")))
    return F.get(F.filter(times, lambda x: x["at"].isNotNull()), F.lit(0))
