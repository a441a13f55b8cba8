"""Index rows of chunks and pairs, the stored index, and its export and import."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import blank_to_null, clip_prefix, collapse, md5_uuid, page_span, rtrim, trim
from loomline.functions.values import compact_metadata, overlay
from loomline.models import Embedder, embed
from loomline.operators.sparse import term_vector
from loomline.session import _hadoop_path


@dataclass(frozen=True)
class ContextConfig:
    enabled: bool = True
    most_prefix: int = 420
    pdf: bool = True
    chat: bool = True
    pairs: bool = True
    mode: str = "question_answer"
    most_answer: int = 700


#: Lines of a prefix: label, the metadata keys whose first value that says something is shown, whether an empty line is left out.
_PAGES = "\0pages"
DOCUMENT_LINES = (
    ("Document", ("pdf_title", "title", "file_name"), False), ("Product", ("product",), False), ("Version", ("doc_version",), False), ("Type", ("doc_type",), False),
    ("Section", ("section_path", "section_title", "active_heading"), False), ("Pages", (_PAGES,), True),
)
ROOM_LINES = (("Room", ("room_title", "title"), False), ("Thread", ("thread_id",), False), ("Messages", ("message_count",), False), ("Updated", ("updated_at", "created_at"), True))
TOPIC = ("Topic", ("thread_start_text",), False)


def _lines(meta: Column, lines: tuple) -> Column:
    """Label: value lines. The cleaning of values is written once, as a lambda over the lines, however many there are."""
    start = F.coalesce(blank_to_null(meta["page_start"]), blank_to_null(meta["page"]))
    pages = page_span(start, blank_to_null(meta["page_end"]))
    rows = [
        F.struct(F.lit(label).alias("label"), F.array(*[pages if k == _PAGES else meta[k] for k in keys]).alias("values"), F.lit(optional).alias("optional"))
        for label, keys, optional in lines
    ]
    first = lambda x: F.coalesce(F.get(F.filter(F.transform(x["values"], lambda v: collapse(v)), lambda v: v != ""), F.lit(0)), F.lit(""))
    shown = F.transform(F.array(*rows), lambda x: F.struct(x["label"].alias("label"), first(x).alias("value"), x["optional"].alias("optional")))
    kept = F.filter(shown, lambda x: (x["value"] != "") | ~x["optional"])
    return F.array_join(F.transform(kept, lambda x: F.concat(x["label"], F.lit(": "), x["value"])), "\n")


def in_context(base: Column, prefix: Column, most: int, label: str) -> Column:
    """Prefix, label and text; blank texts stay blank, an empty prefix adds nothing. Text and prefix are evaluated once."""
    parts = F.array(F.struct(trim(F.coalesce(base, F.lit(""))).alias("text"), clip_prefix(prefix, most).alias("head")))
    whole = lambda x: F.when((x["text"] == "") | (x["head"] == ""), x["text"]).otherwise(F.concat(x["head"], F.lit(f"\n\n{label}:\n"), x["text"]))
    return F.transform(parts, whole)[0]


def chunk_rows(chunks: DataFrame, cfg: ContextConfig = ContextConfig()) -> DataFrame:
    """Index rows of the chunks that are not blank."""
    meta = F.col("metadata")
    kind = F.lower(trim(F.coalesce("source_type", F.lit(""))))
    prefix = F.lit("")
    if cfg.enabled and cfg.pdf:
        prefix = F.when(kind == "pdf", _lines(meta, DOCUMENT_LINES)).otherwise(prefix)
    if cfg.enabled and cfg.chat:
        prefix = F.when(kind == "webex", F.concat(F.lit("Source: Webex discussion\n"), _lines(meta, (*ROOM_LINES, TOPIC)))).otherwise(prefix)
    rows = chunks.withColumn("_t", trim("text")).where("_t <> ''")
    tag = F.create_map(F.lit("record_type"), F.lit("chunk"))
    return rows.select(
        md5_uuid(F.col("chunk_id")).alias("point_id"), F.lit("chunk").alias("record_type"), "chunk_id", "doc_id", "source_ref", "source_type", F.col("_t").alias("text"),
        in_context(F.col("_t"), prefix, cfg.most_prefix, "Chunk").alias("retrieval_text"), overlay(meta, tag).alias("metadata"),
    )


def qa_text(question: Column, answer: Column, mode: str, most: int) -> Column:
    """The text of a pair by mode: question_answer, question_only or answer_only; answers clipped to ``most``."""
    q, a = trim(question), trim(answer)
    a = F.when(F.length(a) > most, rtrim(F.substring(a, 1, most))).otherwise(a) if most > 0 else a
    q, a = F.concat(F.lit("Question: "), q), F.concat(F.lit("Answer: "), a)
    forms = {"question_only": q, "answer_only": a, "question_answer": F.concat(q, F.lit("\n"), a)}
    if mode not in forms:
        raise ValueError(f"mode must be one of: {', '.join(sorted(forms))}")
    return forms[mode]


def pair_rows(pairs: DataFrame, cfg: ContextConfig = ContextConfig()) -> DataFrame:
    """Index rows of question-answer pairs; metadata compacted and linked to the chunk."""
    m = F.col("metadata")
    own = F.create_map(F.lit("qa_generation_mode"), m["qa_generation_mode"], F.lit("thread_start_text"), m["thread_start_text"], F.lit("thread_reply_count"), m["thread_reply_count"].cast("string"), F.lit("thread_reply_user_filter"), m["thread_reply_user_filter"])
    meta = compact_metadata(F.coalesce(m["chunk_metadata"], F.create_map().cast("map<string,string>")), F.map_filter(own, lambda _, v: v.isNotNull()))
    kind = F.lower(trim(F.coalesce("source_type", F.lit(""))))
    rows = pairs.where(F.col("question").isNotNull() & F.col("answer").isNotNull()).withColumn("_m", meta)
    head = F.concat(F.lit("Source: Synthetic QA pair\nQuestion: "), collapse(F.col("question")))
    pdf = (("Document", ("pdf_title", "title"), False), *DOCUMENT_LINES[1:])
    below = F.when(kind == "pdf", _lines(F.col("_m"), pdf)).when(kind == "webex", _lines(F.col("_m"), ROOM_LINES))
    lines = F.concat_ws("\n", head, below)
    text = trim(qa_text(F.col("question"), F.col("answer"), cfg.mode, cfg.most_answer))
    tag = F.create_map(F.lit("record_type"), F.lit("qa_pair"), F.lit("qa_id"), F.col("qa_id"), F.lit("qa_question"), F.col("question"), F.lit("linked_chunk_id"), F.coalesce("chunk_id", F.lit("")), F.lit("qa_answer_chars"), F.length("answer").cast("string"))
    return rows.select(
        md5_uuid(F.col("qa_id")).alias("point_id"), F.lit("qa_pair").alias("record_type"), F.concat(F.lit("qa::"), F.col("qa_id")).alias("chunk_id"), "doc_id", "source_ref", "source_type",
        text.alias("text"), in_context(text, lines if cfg.enabled and cfg.pairs else F.lit(""), cfg.most_prefix, "QA Pair").alias("retrieval_text"), overlay(F.col("_m"), tag).alias("metadata"),
    )


def index_rows(chunks: DataFrame, pairs: DataFrame | None = None, cfg: ContextConfig = ContextConfig(), required: bool = False) -> DataFrame:
    """Rows of chunks and pairs; ``required``: none at all is an error."""
    rows = chunk_rows(chunks, cfg)
    rows = rows if pairs is None else rows.unionByName(pair_rows(pairs, cfg))
    if required and not rows.limit(1).count():
        raise ValueError("no index rows: neither chunks nor pairs have text")
    return rows


def newest(rows: DataFrame, key: str = "point_id") -> DataFrame:
    """One row a key: the latest ingested_at of the metadata, ties by the row's text. A combining aggregate, no window."""
    cols = [c for c in rows.columns if c != key]
    rank = F.struct(F.coalesce(F.col("metadata")["ingested_at"], F.lit("")).alias("at"), F.to_json(F.struct(*cols)).alias("row"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def with_vectors(rows: DataFrame, embedder: Embedder | None = None, sparse: bool = True, most: int = 512) -> DataFrame:
    """Adds what a search reads: ``dense`` (the embedder's vectors) and ``sparse`` (terms, their ids and weights) of the retrieval text."""
    text = F.coalesce("retrieval_text", "text", F.lit(""))
    out = rows.withColumn("dense", embed(text, embedder)) if embedder is not None else rows
    return out.withColumn("sparse", term_vector(text, most)) if sparse else out


def latest(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old``; of repeated new keys the greatest row wins. No window."""
    cols = [c for c in new.columns if c != key]
    plain = F.to_json(F.struct(*cols))
    one = new.groupBy(key).agg(F.max_by(F.struct(*cols), plain).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in cols])
    return old.join(one.select(key), key, "left_anti").unionByName(one)


def write_index(rows: DataFrame, at: str, mode: str = "overwrite") -> None:
    """The index as Parquet, partitioned by source type, so that exports of one source read only that."""
    rows.write.mode(mode).partitionBy("source_type").parquet(at)


def upsert_index(spark: SparkSession, rows: DataFrame, at: str, to: str) -> None:
    """Writes the index at ``at`` merged with ``rows`` to ``to``; the columns must agree."""
    old = spark.read.parquet(at)
    if sorted(old.columns) != sorted(rows.columns):
        raise ValueError(f"index columns differ: {sorted(set(old.columns) ^ set(rows.columns))}")
    write_index(latest(old.select(rows.columns), rows), to)


#: Names of distances, sparse modifiers and number formats in a bundle's configuration.
DISTANCES = ("cosine", "dot", "euclid", "manhattan")
MODIFIERS = ("idf", "none")
DATATYPES = ("float32", "float16", "uint8")


def _known(value: object, names: tuple[str, ...], what: str, empty: bool = False) -> str | None:
    """A name in lower case without underscores; unknown ones are an error."""
    key = str(value if value is not None else "").strip().lower()
    for form in (key, key.replace("_", "")):
        if form in names:
            return form
    if empty and not key:
        return None
    raise ValueError(f"unsupported {what}: {value!r}")


def vectors_config(size: int, distance: str = "cosine", name: str | None = "dense") -> dict:
    """The configuration of dense vectors: named, or single if ``name`` is None."""
    one = {"size": int(size), "distance": _known(distance, DISTANCES, "distance")}
    return {"kind": "named", "vectors": {name: one}} if name else {"kind": "single", **one}


def sparse_config(name: str = "sparse", modifier: str | None = "idf", on_disk: bool | None = None, full_scan: int | None = None, datatype: str | None = None) -> dict:
    index = {"full_scan_threshold": full_scan, "on_disk": on_disk, "datatype": _known(datatype, DATATYPES, "datatype", True)}
    return {name: {"modifier": _known(modifier, MODIFIERS, "modifier", True), "index": index}}


def read_vectors_config(config: dict) -> dict[str | None, tuple[int, str]]:
    """Name (None: single) to (size, distance) of a bundle's configuration; another kind is an error."""
    kind = str(config.get("kind", "single")).strip().lower()
    if kind == "single":
        return {None: (int(config["size"]), _known(config["distance"], DISTANCES, "distance"))}
    named = config.get("vectors")
    if kind != "named" or not isinstance(named, dict) or not named or not all(isinstance(v, dict) for v in named.values()):
        raise ValueError(f"unsupported vectors configuration: {kind!r}")
    return {k: (int(v["size"]), _known(v["distance"], DISTANCES, "distance")) for k, v in named.items()}


def read_sparse_config(config: dict | None) -> dict[str, str | None]:
    """Name to modifier of a bundle's sparse configuration; none gives {}."""
    if config and not (isinstance(config, dict) and all(isinstance(v, dict) for v in config.values())):
        raise ValueError("sparse configuration must be a mapping of mappings")
    for v in (config or {}).values():
        _known((v.get("index") or {}).get("datatype"), DATATYPES, "datatype", True)
    return {k: _known(v.get("modifier"), MODIFIERS, "modifier", True) for k, v in (config or {}).items()}


def export_index(rows: DataFrame, at: str, name: str = "docs", sources: tuple[str, ...] = (), distance: str = "cosine") -> dict:
    """JSON Lines of the points of ``sources`` (all if none), vectors included, and a manifest beside them."""
    wanted = sorted({s.strip().lower() for s in sources if s.strip()})
    picked = rows.where(F.lower("source_type").isin(*wanted)) if wanted else rows
    picked.write.mode("overwrite").json(f"{at}/points")
    size = F.max(F.size("dense")) if "dense" in rows.columns else F.lit(None).cast("int")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.lower("source_type").isin(*wanted) if wanted else F.lit(True)).alias("k"), size.alias("size")).first()
    manifest = {
        "schema_version": 2, "collection_name": name, "source_filter": wanted, "points_file": "points",
        "points_count": counts["k"], "scanned_points": counts["n"], "filtered_out_points": counts["n"] - counts["k"],
        "vectors_config": vectors_config(counts["size"] or 0, distance), "sparse_vectors_config": sparse_config() if "sparse" in rows.columns else {},
    }
    rows.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
    return manifest


def read_manifest(spark: SparkSession, at: str) -> dict:
    """The manifest of a bundle, checked."""
    path, fs = _hadoop_path(spark, f"{at}/manifest")
    if not fs.exists(path):
        raise ValueError(f"no manifest at {at}")
    lines = [r["value"] for r in spark.read.text(f"{at}/manifest").take(2)]
    found = json.loads(lines[0]) if len(lines) == 1 else {}
    if not isinstance(found, dict) or found.get("schema_version") != 2:
        raise ValueError(f"unsupported bundle at {at}")
    read_vectors_config(found["vectors_config"])
    read_sparse_config(found.get("sparse_vectors_config"))
    return found


def import_index(spark: SparkSession, at: str, schema, to: str | None = None, recreate: bool = False, vectors: bool = False) -> DataFrame:
    """The points of a bundle; ``to``: also written there, merged with an index that stands there unless ``recreate``.

    A missing manifest, another version, a point without an id and (``vectors``, or wherever the manifest has a size) a
    point without a dense vector of that size are errors.
    """
    manifest = read_manifest(spark, at)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{at}/{manifest['points_file']}")
    checked = F.when(F.col("point_id").isNull(), F.raise_error(F.lit("point without id"))).otherwise(F.col("point_id"))
    size = next(iter(read_vectors_config(manifest["vectors_config"]).values()))[0]
    if vectors or size:
        if "dense" not in rows.columns:
            raise ValueError("the schema has no dense vectors")
        bad = F.col("dense").isNull() | ((F.size("dense") != size) if size else F.lit(False))
        checked = F.when(bad, F.raise_error(F.lit("point without a vector of the bundle's size"))).otherwise(checked)
    rows = rows.withColumn("point_id", checked)
    if to is not None:
        path, fs = _hadoop_path(spark, to)
        if recreate or not fs.exists(path):
            write_index(rows, to)
        else:
            from loomline.session import Stage

            merged = Stage(latest(spark.read.parquet(to).select(rows.columns), rows), "merged")  # read before it is overwritten
            write_index(merged.df, to)
            merged.drop()
    return rows
