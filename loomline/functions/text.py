"""Text expressions: all run inside the JVM unless noted. Null texts give null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that end no sentence.
ABBREVIATIONS = (
    "al. approx. art. cf. ch. co. corp. dept. dr. e.g. eq. etc. fig. i.e. inc. jr. mr. mrs. ms. no. p. pg. pp. prof. sec. sr. st. vs."
).split()
#: Phrases of a question that asks for recent content.
RECENT = ("latest", "recent", "recently", "current", "updated", "today", "yesterday", "this week", "this month", "last week", "last month")
#: Phrases of an answer that abstains.
ABSTAIN = (
    "i do not know",
    "i don't know",
    "cannot determine from the retrieved context",
    "can't determine from the retrieved context",
    "not enough information in the retrieved context",
    "insufficient information in the retrieved context",
    "not present in the retrieved context",
    "not available in the retrieved context",
    "not enough evidence in the retrieved context",
)
#: Fixed value: appended to clipped texts.
MARKER = "\n...[truncated]"
#: Lexical tokens with inner separators, and the separators.
COMPOUND = r"[A-Za-z0-9]+(?:[-_./:][A-Za-z0-9]+)*"
SEPARATORS = r"[-_./:]+"
#: Fixed value: query terms that a snippet is placed by.
SNIPPET_TERM = r"[A-Za-z0-9][A-Za-z0-9._/-]*"


#: Fixed value: white space of any kind.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def rtrim(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trim(text), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def stable_id(*parts: Column) -> Column:
    """SHA-1 of the parts joined by ||; null parts count as empty."""
    return F.sha1(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def md5_uuid(text: Column) -> Column:
    """The MD5 of a text in the form of a UUID."""
    return F.regexp_replace(F.md5(text), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, their lines joined by single spaces; empty ones dropped."""
    parts = F.transform(F.split(unix_newlines(F.coalesce(text, F.lit(""))), r"\n\s*\n+"), lambda p: collapse(p))
    return F.filter(parts, lambda p: p != "")


def is_abbreviation(token: Column) -> Column:
    """Whether a token such as ``e.g.`` or ``U.S.`` ends no sentence."""
    bare = F.regexp_replace(token, r"""["')\]}]+$""", "")
    return F.lower(bare).isin(*ABBREVIATIONS) | bare.rlike(r"^(?:[A-Za-z]\.){2,}$")


def lexical_terms(text: Column, least: int = 2) -> Column:
    """Lower-case tokens, compound ones whole and in parts, in order; a part equal to its whole is not repeated."""
    least = max(1, least)
    whole = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(COMPOUND), F.lit(0)), lambda t: F.lower(t))
    parts = lambda t: F.concat(F.array(t), F.filter(F.split(t, SEPARATORS), lambda p: p != t))
    spread = F.flatten(F.transform(whole, lambda t: F.when(t.rlike(SEPARATORS), parts(t)).otherwise(F.array(t))))  # few terms are compound
    return F.filter(spread, lambda t: F.length(t) >= least)


def qa_words(text: Column) -> Column:
    """Distinct lower-case words of at least four letters, digits or apostrophes."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9']+"), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= 4))


def overlap_share(answer: Column, context: Column) -> Column:
    """Share of an answer's words found in the context; 0 if either has none."""
    a, c = qa_words(answer), qa_words(context)
    return F.when((F.size(a) == 0) | (F.size(c) == 0), 0.0).otherwise(F.size(F.array_intersect(a, c)) / F.size(a))


def token_count(text: Column) -> Column:
    """A token estimate: pieces (words or marks), but at least a quarter of the characters; 0 for blank texts.

    Letters, digits and underscores make words; joiners and combining marks are marks, as in Python.
    """
    clean = trim(F.coalesce(text, F.lit("")))
    pieces = F.size(F.regexp_extract_all(clean, F.lit(r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))
    return F.when(clean == "", 0).otherwise(F.greatest(pieces, F.greatest(F.lit(1), F.floor(F.length(clean) / 4).cast("int"))))


def clip(text: Column, most: int | Column, marker: str = MARKER) -> Column:
    """At most ``most`` characters, the marker included where it fits; most <= 0: no limit."""
    limit = most if isinstance(most, Column) else F.lit(most)
    clean, room = trim(F.coalesce(text, F.lit(""))), limit - len(marker)
    cut = F.when(room <= 0, F.substring(clean, F.lit(1), limit)).otherwise(F.concat(rtrim(F.substring(clean, F.lit(1), room)), F.lit(marker)))
    return F.when((limit <= 0) | (F.length(clean) <= limit), clean).otherwise(cut)


def clip_prefix(text: Column, most: int) -> Column:
    clean = collapse(F.coalesce(text, F.lit("")))
    return clean if most <= 0 else rtrim(F.substring(clean, 1, most))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(collapse(F.coalesce(text, F.lit(""))))
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(low, F.lit(phrase))
    return hit


def asks_for_recent(question: Column) -> Column:
    return contains_any(question, RECENT)


def abstains(answer: Column) -> Column:
    """Blank answers abstain as well."""
    low = F.lower(trim(F.coalesce(answer, F.lit(""))))
    hit = low == ""
    for phrase in ABSTAIN:
        hit = hit | F.contains(low, F.lit(phrase))
    return hit


def phrase_hits(answer: Column, phrases: Column) -> Column:
    """The phrases that an answer contains, in their order, regardless of case."""
    return F.filter(phrases, lambda p: F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(p)))


def distinct_texts(texts: Column) -> Column:
    """Trimmed, non-blank, each once, first occurrence first."""
    return F.array_distinct(F.filter(F.transform(texts, lambda t: trim(t)), lambda t: t != ""))


def match_key(text: Column) -> Column:
    return F.lower(collapse(text))


def snippet(text: Column, query: Column, most: int = 420) -> Column:
    """A window of ``most`` characters around the earliest query term of three characters or more, with ellipses."""
    clean = collapse(F.coalesce(text, F.lit("")))
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(SNIPPET_TERM), F.lit(0)), lambda t: F.length(t) >= 3)

    def around(c: Column) -> Column:
        found = F.filter(F.transform(terms, lambda t: F.instr(F.lower(c), t)), lambda p: p > 0)
        first = F.greatest(F.lit(0), F.coalesce(F.array_min(found) - 1, F.lit(0)) - most // 3)
        end = F.least(F.length(c), first + most)
        start = F.greatest(F.lit(0), end - most)
        body = trim(F.substring(c, start + 1, end - start))
        return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(c), "...").otherwise(""))

    return F.transform(F.array(clean), lambda c: F.when(F.length(c) <= most, c).otherwise(around(c)))[0]


def clean_rewrite(output: Column, fallback: Column) -> Column:
    """A rewritten query from model output: JSON field, code fence and label removed; empty or sentinel: the fallback."""
    bare = trim(F.regexp_replace(output, r"(?s)^\s*```\w*\s*|\s*```\s*$", ""))
    blob = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    field = F.coalesce(*[blank_to_null(F.get_json_object(F.nullif(blob, F.lit("")), f"$.{k}")) for k in ("query", "search_query", "rewritten_query", "question")])
    text = F.regexp_replace(F.coalesce(field, bare), r"(?i)^\s*(?:rewritten|standalone|search|retrieval)?\s*(?:query|question)\s*:\s*", "")
    text = F.regexp_replace(collapse(text), r"""^["'`]+|["'`]+$""", "")
    return F.when(text.isNull() | (text == "") | F.lower(text).isin("same as above", "unchanged", "n/a", "none"), fallback).otherwise(text)


def is_heading(text: Column) -> Column:
    """Numbered prefix, or short text without a full stop whose letters are mostly upper case."""
    t = trim(F.coalesce(text, F.lit("")))
    letters, ups = (F.length(F.regexp_replace(t, p, "")) for p in (r"[^\p{L}]", r"[^\p{Lu}]"))
    short = (F.size(F.split(t, r"(?U)\s+")) <= 14) & (F.length(t) <= 120) & ~t.endswith(".")
    return t.rlike(r"(?i)^(?:chapter\s+)?\d+(?:\.\d+)*\s+\S+") | (short & (letters > 0) & (ups >= 0.65 * letters))


def page_span(start: Column, end: Column) -> Column:
    """'a', 'a-b' or ''."""
    a, b = start.cast("string"), end.cast("string")
    return F.when(a.isNull(), "").when(b.isNull() | (a == b), a).otherwise(F.concat(a, F.lit("-"), b))


def pdf_page(source_ref: Column) -> Column:
    """The first page that a reference names, null if none."""
    return F.regexp_extract(source_ref, r"[#:]pages?=(\d+)", 1).try_cast("int")


def safe_file_name(name: Column, most: int = 80) -> Column:
    clean = F.regexp_replace(F.regexp_replace(trim(F.coalesce(name, F.lit(""))), r"[^\w.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", "file").otherwise(F.substring(clean, 1, most))


def answer_time(seconds: Column) -> Column:
    """'850 ms', '12.3 s' or '2m 5.0s'; '' for null and negative times."""
    s = seconds.cast("double")
    return (
        F.when(s.isNull() | (s < 0), "").when(s < 1, F.format_string("%.0f ms", s * 1000)).when(s < 60, F.format_string("%.1f s", s))
        .otherwise(F.format_string("%dm %.1fs", F.floor(s / 60).cast("int"), s - F.floor(s / 60) * 60))
    )


def score_explanation(score: Column, first: Column, rerank: Column, recency: Column) -> Column:
    """The parts of a final score; parts that are null are left out."""
    part = lambda label, c: F.when(c.isNotNull(), F.format_string(f"{label}=%.4f", c.cast("double")))
    return F.concat_ws(", ", F.format_string("final=%.4f", F.coalesce(score.cast("double"), F.lit(0.0))), part("vector", first), part("rerank", rerank), part("recency_bonus", recency))


def page_label(source_ref: Column, metadata: Column) -> Column:
    """The pages of a source: metadata, else the reference's pages or section, else 'unknown'."""
    digits = lambda k: F.when(metadata[k].rlike(r"^\d+$"), metadata[k])
    span = page_span(F.coalesce(digits("page_start"), digits("page")), digits("page_end"))
    named = F.coalesce(F.nullif(F.regexp_extract(source_ref, r"pages?=(\d+(?:-\d+)?)", 1), F.lit("")), F.nullif(F.regexp_extract(source_ref, r"section=(\d+(?:-\d+)?)", 1), F.lit("")))
    return F.coalesce(F.nullif(span, F.lit("")), named, F.lit("unknown"))


def source_line(kind: Column, source_ref: Column, record_type: Column, metadata: Column, score: Column, first: Column) -> Column:
    """One line about a retrieved source, by its kind."""
    name = lambda *keys: F.coalesce(*[blank_to_null(metadata[k]) for k in keys], F.lit("unknown"))
    scores = F.concat_ws(", ", F.format_string("score=%.4f", F.coalesce(score.cast("double"), F.lit(0.0))), F.when(first.isNotNull(), F.format_string("vec=%.4f", first.cast("double"))))
    ref = F.coalesce(source_ref, F.lit("unknown"))
    pdf = F.format_string("- PDF: `%s` | chapter: `%s` | page: `%s` (%s)", name("pdf_title", "title", "file_name"), name("section_title", "active_heading"), page_label(ref, metadata), scores)
    chat = F.format_string("- Webex Space: `%s` | Timestamp: `%s` (%s)", name("room_title", "title"), name("created_at"), scores)
    other = F.format_string("- `%s` [%s] (%s)", ref, F.coalesce(record_type, F.lit("chunk")), scores)
    return F.when(kind == "pdf", pdf).when(kind == "webex", chat).otherwise(other)
