"""Command line over the library: flags beat the settings file, which beats the defaults."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomline.models import HashEmbedder, PassageGenerator
from loomline.operators import chunking, generation, qa, sections, threads
from loomline.plans import evaluate, index, retrieve
from loomline.sources import chat, pdf
from loomline.sources.jsonl import read_settings


def setting(flag, settings: dict, key: str, default):
    if flag not in (None, ""):
        return flag
    value = settings.get(key)
    return default if value in (None, "") else value


COMMANDS = {
    "ingest-chat": ("input", "output"), "ingest-pdf": ("input", "output", "target", "least"), "chunk": ("input", "output", "size", "overlap", "least"),
    "generate": ("input", "output", "progress", "resume", "most", "user"), "validate": ("input", "output"), "split": ("input", "output", "seed", "train", "valid"),
    "index": ("chunks", "pairs", "output", "dims"), "search": ("input", "queries", "output", "k"), "eval-retrieval": ("input", "cases", "output", "k"), "eval-answers": ("input", "output"),
    "export": ("input", "output", "source", "distance"), "import": ("input", "output", "recreate"),
}
POINT = (
    "point_id string, record_type string, chunk_id string, doc_id string, source_ref string, text string, retrieval_text string, metadata map<string,string>, dense array<float>, "
    "sparse array<struct<term:string,term_id:bigint,weight:double>>, source_type string"
)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loomline")
    parser.add_argument("--settings", default="")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, flags in COMMANDS.items():
        one = sub.add_parser(name)
        for flag in flags:
            one.add_argument(f"--{flag}", default="")
    return parser


def ingest_chat(spark, get):
    raw = chat.read_dump(spark, get("input")).withColumn("ingested_at", F.current_timestamp())
    rooms = raw.select("room_id", F.col("room_id").alias("title"), F.lit("group").alias("room_type")).distinct()
    return threads.thread_records(raw, rooms)


def ingest_pdf(spark, get):
    toc, pages = pdf.contents_tables(pdf.read_contents(spark, get("input")))
    ranges = sections.section_ranges(toc, pages)
    units = sections.page_paragraphs(pdf.read_blocks(spark, get("input")).where("error is null"))
    return sections.section_records(sections.pack_sections(ranges, units, int(get("target", 900)), int(get("least", 220))), ranges)


def make_chunks(spark, get):
    return chunking.chunk_documents(spark.read.parquet(get("input")), int(get("size", 1100)), int(get("overlap", 180)), int(get("least", 160)))


def make_index(spark, get):
    pairs = spark.read.parquet(get("pairs")) if get("pairs") else None
    rows = index.index_rows(spark.read.parquet(get("chunks")), pairs, required=True)
    index.write_index(index.with_vectors(index.newest(rows), HashEmbedder(int(get("dims", 64)))), get("output"))


def found(spark, get, queries):
    points = spark.read.parquet(get("input"))
    dims = points.select(F.size("dense").alias("n")).first()["n"]
    return retrieve.search(points, queries, F.current_timestamp(), HashEmbedder(dims), k=int(get("k", 12)))


def eval_retrieval(spark, get):
    cases = evaluate.load_cases(spark.read.parquet(get("cases")))
    rows = found(spark, get, cases.select("query", F.col("question").alias("search")))
    rows = rows.withColumn("linked_chunk_id", F.col("metadata")["linked_chunk_id"]).withColumn("recency_bonus", F.col("recency.bonus"))
    return evaluate.case_reports(rows, cases, int(get("k", 12)))


def split_pairs(spark, get):
    pairs = spark.read.parquet(get("input"))
    names = qa.exact_split(pairs, "qa_id", int(get("seed", 42)), float(get("train", 0.9)), float(get("valid", 0.08)))
    pairs.join(names, "qa_id").write.mode("overwrite").partitionBy("split_name").parquet(get("output"))


def judge_pairs(spark, get):
    pairs = spark.read.parquet(get("input")).withColumns({"context": F.col("metadata.chunk_text"), "mode": F.col("metadata.qa_generation_mode")})
    qa.judge(pairs, "qa_id", mode="mode", required=("question", "answer")).write.mode("overwrite").partitionBy("reason").parquet(get("output"))


def make_pairs(spark, get):
    cfg = generation.GenerationConfig(user=str(get("user", "")))
    resume = str(get("resume", "true")).lower() not in ("false", "no", "0")
    counts = generation.run_generation(spark, spark.read.parquet(get("input")), get("output"), get("progress", f"{get('output')}.progress"), PassageGenerator(), cfg, resume, int(get("most", 0)))
    print(json.dumps(counts, sort_keys=True))


RUN = {
    "ingest-chat": ingest_chat, "ingest-pdf": ingest_pdf, "chunk": make_chunks, "generate": make_pairs, "validate": judge_pairs, "split": split_pairs, "index": make_index, "eval-retrieval": eval_retrieval,
    "search": lambda spark, get: found(spark, get, spark.read.parquet(get("queries"))), "eval-answers": lambda spark, get: evaluate.answer_report(spark.read.parquet(get("input"))),
    "export": lambda spark, get: index.export_index(spark.read.parquet(get("input")), get("output"), sources=tuple(str(get("source", "")).split(",")), distance=get("distance", "cosine")) and None,
    "import": lambda spark, get: index.import_index(spark, get("input"), POINT, get("output"), str(get("recreate", "")).lower() in ("true", "yes", "1")) and None,
}


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    settings = read_settings(args.settings) if args.settings else {}
    get = lambda key, default=None: setting(getattr(args, key, None), settings, key, default)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = RUN[args.command](spark, get)
    if out is not None:
        out.write.mode("overwrite").parquet(get("output"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
