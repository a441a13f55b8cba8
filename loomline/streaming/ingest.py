"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.values import instant


def message_stream(spark: SparkSession, at: str, schema, format: str = "parquet", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", per_trigger).load(at)


def once_per_message(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each message id once within the watermark of ``ingested_at``."""
    return stream.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["message_id"])


def room_activity(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Messages per room and window of event time; late rows beyond the watermark are dropped."""
    timed = stream.withColumn("at", instant(F.col("created"))).where("at is not null").withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "room_id").agg(F.count("*").alias("messages"))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``handle`` for every micro-batch of what is there now; resumable by its checkpoint."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(chunks: DataFrame, done_at: str, key: str = "chunk_id") -> Callable[[DataFrame, int], None]:
    """A batch handler that appends rows whose key is not in the table at ``done_at``."""

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(done_at).select(key)
            batch = batch.join(done, key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.dropDuplicates([key]).write.mode("append").parquet(done_at)

    return handle
