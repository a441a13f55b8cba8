"""JSON Lines, JSON documents and settings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import _hadoop_path


def read_strict(spark: SparkSession, at: str, schema) -> DataFrame:
    """Blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(at)


def read_tolerant(spark: SparkSession, at: str, schema) -> DataFrame:
    """Malformed lines are skipped; a missing path gives no rows."""
    path, fs = _hadoop_path(spark, at)
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(at)


def load_documents(spark: SparkSession, places: list[str], schema, required: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, DataFrame]:
    """(records, rejected): the documents of all places that exist; rows that lack a required field are rejected, malformed lines skipped."""
    rows = None
    for at in places:
        one = read_tolerant(spark, at, schema)
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no places to read")
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    return rows.where(~bad), rows.where(bad)


def line_count(spark: SparkSession, at: str) -> int:
    """Lines that are not blank."""
    return spark.read.text(at).where(F.trim("value") != "").count()


def write(df: DataFrame, at: str, mode: str = "overwrite") -> int:
    """Writes (mode append: adds) one JSON object a line and gives the number of rows."""
    df.write.mode(mode).json(at)
    return df.sparkSession.read.text(at).count() if mode == "overwrite" else df.count()


def repair_tail(lines: DataFrame, pos: str = "line_no", value: str = "value") -> DataFrame:
    """The lines before the first malformed one; ``pos`` orders them. Files of our own sinks commit whole and need none."""
    bad = lines.where((F.trim(value) != "") & F.try_parse_json(value).isNull()).agg(F.min(pos).alias("_bad"))
    return lines.join(F.broadcast(bad), F.col("_bad").isNull() | (F.col(pos) < F.col("_bad"))).drop("_bad")


def numbered_lines(spark: SparkSession, at: str) -> DataFrame:
    """(line_no bigint, value): the lines of one text file with their place; a range of the file is numbered by the bytes before it.

    Files of JSON Lines are read whole by one task each here, as their tail is what matters.
    """
    whole = spark.read.text(at, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")).where("value <> ''").withColumn("line_no", F.col("line_no").cast("bigint"))


def repair_file(spark: SparkSession, at: str, to: str) -> int:
    """Writes the lines of the file ``at`` before its first malformed one to ``to``; gives the number of lines dropped."""
    lines = numbered_lines(spark, at)
    kept = repair_tail(lines)
    kept.coalesce(1).sortWithinPartitions("line_no").select("value").write.mode("overwrite").text(to)
    return lines.count() - kept.count()


def access_token(settings: dict, variable: str = "WEBEX_ACCESS_TOKEN", key: str = "access_token") -> str:
    """The token of the settings, else of the environment; none is an error."""
    import os

    token = str(settings.get(key) or os.environ.get(variable) or "").strip()
    if not token:
        raise ValueError(f"no token: set {key} or {variable}")
    return token


def read_document(at: str) -> object:
    return json.loads(Path(at).read_text(encoding="utf-8"))


def write_document(at: str, payload: object) -> None:
    path = Path(at)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(payload, ensure_ascii=False, indent=2), encoding="utf-8")


def read_settings(at: str, allowed: set[str] | None = None) -> dict:
    """Settings from YAML (if installed) or JSON; the root must be a mapping, unknown keys are an error."""
    text = Path(at).read_text(encoding="utf-8")
    try:
        import yaml

        data = yaml.safe_load(text) or {}
    except ImportError:
        data = json.loads(text or "{}")
    if not isinstance(data, dict):
        raise ValueError("settings must be a mapping")
    if allowed is not None and (odd := sorted(set(data) - allowed)):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    return data
