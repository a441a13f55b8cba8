"""PDF files as page blocks; parsing needs an optional library, everything after runs on block rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BLOCKS = "file string, page int, block_no int, block_type int, text string, error string"


def read_blocks(spark: SparkSession, at: str) -> DataFrame:
    """Blocks of all .pdf files under ``at``; a file that cannot be read gives one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(at).select("path", "content")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    import fitz

                    for no, page in enumerate(fitz.open(stream=bytes(content), filetype="pdf"), 1):
                        blocks = sorted(page.get_text("blocks"), key=lambda b: (b[1], b[0])) or [(0, 0, 0, 0, page.get_text(), 0, 0)]
                        rows += [(path, no, i, int(b[6]), b[4], None) for i, b in enumerate(blocks)]
                except Exception as e:  # noqa: BLE001 one bad file must not end the job
                    rows.append((path, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["file", "page", "block_no", "block_type", "text", "error"])

    return files.mapInPandas(parse, BLOCKS)


TOC = "file string, title string, page_count int, entries array<struct<pos:int,level:int,title:string,page:int>>, error string"


def read_contents(spark: SparkSession, at: str) -> DataFrame:
    """(file, title, page_count, entries, error) of all .pdf files under ``at``: the outline that sections are cut by."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(at).select("path", "content")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    import fitz

                    doc = fitz.open(stream=bytes(content), filetype="pdf")
                    entries = [{"pos": i, "level": int(e[0]), "title": e[1], "page": int(e[2])} for i, e in enumerate(doc.get_toc() or [])]
                    rows.append((path, (doc.metadata or {}).get("title") or None, len(doc), entries, None))
                except Exception as e:  # noqa: BLE001 one bad file must not end the job
                    rows.append((path, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["file", "title", "page_count", "entries", "error"])

    return files.mapInPandas(parse, TOC)


def contents_tables(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(toc, pages) as ``operators.sections.section_ranges`` takes them."""
    good = contents.where("error is null")
    toc = good.selectExpr("file", "explode(entries) as e").selectExpr("file", "e.pos", "e.level", "e.title", "e.page")
    return toc, good.select("file", "page_count")
