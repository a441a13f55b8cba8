"""Session construction, table loading and lineage cutting."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` under ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, where it comes in fewer partitions than there are cores (small tables in one file); else as it is.

    For work on whole texts. Rows go by the hash of ``key``, so that a repeated task gives the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, else the context's checkpoint folder.

    Only where both are unset on one machine (tests) a local folder is made and noted in the session; on a cluster that
    is an error, as a folder of one machine would be read back short.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(?:\[[\d*, ]+\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _hadoop_path(spark: SparkSession, at: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


_STAGES: list[Stage] = []


class Stage:
    """A table written to the shared folder, so that later steps start from files, not from lineage.

    Files outlive executors: a lost executor costs a re-read, never a recomputation of what came before.
    """

    def __init__(self, df: DataFrame, label: str = "stage"):
        self.spark = df.sparkSession
        self.at = f"{shared_folder(self.spark)}/loomline-{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.at)
        self.df = self.spark.read.schema(df.schema).parquet(self.at)
        _STAGES.append(self)

    def drop(self) -> None:
        path, fs = _hadoop_path(self.spark, self.at)
        fs.delete(path, True)
        if self in _STAGES:
            _STAGES.remove(self)


class staging:
    """Stages made inside are dropped at its end, but for those that ``keep`` was called with; only what is kept may be read later."""

    def __enter__(self) -> staging:
        self.before, self.kept = set(map(id, _STAGES)), []
        return self

    def keep(self, stage: Stage) -> DataFrame:
        self.kept.append(stage)
        return stage.df

    def __exit__(self, *error) -> None:
        for stage in [s for s in _STAGES if id(s) not in self.before and s not in self.kept]:
            stage.drop()


def release_stages() -> None:
    """Deletes the staged tables of this process. For the caller, once the results that read them are written."""
    for stage in list(_STAGES):
        stage.drop()


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df``, written once to the shared folder and read back."""
    return Stage(df, label).df


def clear_folder(at: str) -> None:
    """Removes a local folder made by ``shared_folder``."""
    local = at.removeprefix("file://")
    if os.path.basename(local).startswith("loomline-"):
        shutil.rmtree(local, ignore_errors=True)
