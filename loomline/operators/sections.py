"""Sections of paged documents from tables of contents and page blocks.

Input: toc (file, pos, level, title, page), pages (file, page_count), blocks (file, page, block_no, block_type, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import blank_to_null, collapse, is_heading, paragraphs, stable_id
from loomline.operators.chunking import divided, group_starts, joined, kept_starts, ranges_of

UNTITLED = "Untitled Section"


def _paths(entries: Column) -> Column:
    """The headings above each entry and its own, joined by ' > '; an entry ends all headings of its level and below."""
    empty = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("above"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        above = F.concat(F.filter(acc["above"], lambda x: x["level"] < e["level"]), F.array(F.struct(e["level"].alias("level"), e["title"].alias("title"))))
        name = lambda s: F.array_join(F.filter(F.transform(s, lambda x: x["title"]), lambda t: t != ""), " > ")
        return F.transform(F.array(above), lambda s: F.struct(s.alias("above"), F.concat(acc["out"], F.array(F.coalesce(F.nullif(name(s), F.lit("")), F.lit(UNTITLED)))).alias("out")))[0]

    return F.aggregate(entries, empty, step, lambda acc: acc["out"])


def section_ranges(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, section_no, title, level, path, page_start, page_end).

    Pages are clamped to the file, entries without a page ignored; entries of level 1 win if there are any; of several
    that begin on a page the first by level and title stays; a section ends before the next begins. Blank titles read
    Untitled Section. Files without entries are one section; files without pages have none. A file's table of contents is
    one row, as a heading's path depends on all before it.
    """
    title = collapse(F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)))
    entry = F.struct("pos", F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)).cast("int").alias("level"), title.alias("title"), "page")
    lists = toc.where("page is not null").groupBy("file").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    each = lists.withColumn("p", _paths(F.col("e"))).select("file", F.explode(F.arrays_zip("e", "p")).alias("z")).select("file", "z.e.level", "z.e.title", "z.e.page", F.col("z.p").alias("path"))
    rows = each.join(pages.where("page_count > 0"), "file").withColumn("page", F.least(F.greatest(F.col("page"), F.lit(1)), F.col("page_count")))
    rows = rows.withColumn("_top", F.min("level").over(Window.partitionBy("file"))).where("level = 1 or _top > 1")
    order = Window.partitionBy("file", "page").orderBy("level", F.lower("title"), "title", "path")
    firsts = rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    by_page = Window.partitionBy("file").orderBy("page")
    ranged = firsts.select(
        "file", F.row_number().over(by_page).alias("section_no"), F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)).alias("title"), "level", "path", F.col("page").alias("page_start"),
        F.greatest(F.coalesce(F.lead("page").over(by_page) - 1, F.col("page_count")), F.col("page")).alias("page_end"),
    )
    bare = pages.where("page_count > 0").join(ranged.select("file").distinct(), "file", "left_anti")
    whole = bare.select("file", F.lit(1).alias("section_no"), F.col("file").alias("title"), F.lit(1).alias("level"), F.col("file").alias("path"), F.lit(1).alias("page_start"), F.col("page_count").alias("page_end"))
    return ranged.unionByName(whole)


def section_pages(ranges: DataFrame) -> DataFrame:
    """One row per page of each section: a sequence, so the join with blocks is by equality."""
    return ranges.withColumn("page", F.explode(F.sequence("page_start", "page_end")))


def page_paragraphs(blocks: DataFrame) -> DataFrame:
    """(file, page, unit_no, text): text blocks in order, their paragraphs in order."""
    text = blocks.where("block_type = 0").where(blank_to_null(F.col("text")).isNotNull())
    units = text.select("file", "page", "block_no", F.posexplode(paragraphs(F.col("text"))).alias("par", "text"))
    return units.withColumn("unit_no", F.row_number().over(Window.partitionBy("file", "page").orderBy("block_no", "par"))).select("file", "page", "unit_no", "text")


def pack_sections(ranges: DataFrame, units: DataFrame, target: int = 900, least: int = 220) -> DataFrame:
    """(file, section_no, chunk_no, heading, text, page_start, page_end, pages, paragraph_count, sentence_split_count).

    Units are packed up to ``target`` under their last heading (first the section's title); headings are no text. A chunk
    shorter than ``least`` joins the one before it under an equal heading. A section is one row while it is packed: it is
    bounded by its file.
    """
    title = ranges.select("file", "section_no", F.col("title").alias("_title"))
    rows = section_pages(ranges).select("file", "section_no", "page").join(units, ["file", "page"]).withColumn("_is", is_heading(F.col("text")))
    sofar = Window.partitionBy("file", "section_no").orderBy("page", "unit_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_no": F.sum(F.col("_is").cast("int")).over(sofar), "_head": F.last(F.when(F.col("_is"), F.col("text")), ignorenulls=True).over(sofar)}).where("not _is")
    parts = rows.select("file", "section_no", "page", "unit_no", "_no", "_head", F.posexplode(divided(F.array("text"), target)).alias("part_no", "_p"))
    unit = F.struct("page", "unit_no", "part_no", F.col("_no").alias("no"), F.col("_head").alias("head"), F.col("_p.text").alias("text"), (F.col("_p.parts") > 1).alias("split"))
    lists = parts.groupBy("file", "section_no").agg(F.array_sort(F.collect_list(unit)).alias("u")).join(title, ["file", "section_no"])
    n = F.size("u")
    breaks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i > 0) & (F.get("u", i)["no"] != F.get("u", i - 1)["no"]))
    lists = lists.withColumn("t", F.transform("u", lambda x: x["text"])).withColumn("b", breaks)
    lists = lists.withColumn("s", ranges_of(group_starts(F.transform("t", lambda x: F.length(x)), target, 2, F.col("b")), n))
    head = lambda span: F.coalesce(F.get("u", span["a"])["head"], F.col("_title"))
    starts = kept_starts(F.col("s"), lambda span: F.length(joined(F.col("t"), span, "\n\n")), least, lambda x, y: head(x) == head(y))
    lists = lists.withColumn("k", ranges_of(F.transform(starts, lambda i: F.get("s", i)["a"]), n))
    own = lambda span: F.slice("u", span["a"] + 1, span["b"] - span["a"])
    chunk = F.transform(
        "k",
        lambda span: F.struct(
            head(span).alias("heading"), joined(F.col("t"), span, "\n\n").alias("text"), F.array_sort(F.array_distinct(F.transform(own(span), lambda x: x["page"]))).alias("pages"),
            (span["b"] - span["a"]).alias("paragraph_count"), F.size(F.filter(own(span), lambda x: x["split"])).alias("sentence_split_count"),
        ),
    )
    out = lists.select("file", "section_no", F.posexplode(chunk).alias("chunk_no", "c"))
    first, last = F.element_at("c.pages", 1), F.element_at("c.pages", -1)
    return out.select("file", "section_no", "chunk_no", "c.heading", "c.text", first.alias("page_start"), last.alias("page_end"), "c.pages", "c.paragraph_count", "c.sentence_split_count")


def section_records(plans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Document records of packed sections: reference, id, path with heading, page set."""
    rows = plans.join(ranges.select("file", "section_no", "title", "path", F.col("page_start").alias("s"), F.col("page_end").alias("e")), ["file", "section_no"])
    ref = F.format_string("pdf::%s#section=%d-%d:pages=%d-%d:block=%d", "file", "s", "e", "page_start", "page_end", "chunk_no")
    sub = F.col("heading") != F.col("title")
    path = F.when(sub, F.concat("path", F.lit(" > "), "heading")).otherwise(F.col("path"))
    key = stable_id(F.lit("pdf-section"), F.col("file"), F.col("s"), F.col("e"), F.col("page_start"), F.col("page_end"), F.col("chunk_no"), F.col("heading"))
    markdown = F.concat(F.lit("## "), F.col("title"), F.when(sub, F.concat(F.lit("\n### "), F.col("heading"))).otherwise(""), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    return rows.select(key.alias("doc_id"), F.lit("pdf").alias("source_type"), ref.alias("source_ref"), F.col("file").alias("source_path"), "title", F.col("page_start").alias("page"), "text", markdown.alias("markdown"), path.alias("section_path"), "pages", "paragraph_count", "sentence_split_count")
