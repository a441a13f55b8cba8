"""Joins that hold up when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hub holds at least 1/HUB_SHARE of the rows, so there are at most HUB_SHARE hubs; smaller hot keys are split by adaptive execution.
HUB_SHARE = 500
LEAST = 10_000
#: Rows of a hub that one task takes.
TASK_ROWS = 500_000
LEAST_SALTS = 8


def hubs_of(df: DataFrame, key: str, rows: int | None = None) -> list[tuple[object, int]]:
    """(key, number of tasks) of the keys with at least max(LEAST, rows / HUB_SHARE) rows; one aggregate, combined before its shuffle.

    At most HUB_SHARE keys reach the driver, by the definition of a hub.
    """
    rows = df.count() if rows is None else rows
    if rows < LEAST:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= max(LEAST, rows // HUB_SHARE))
    return [(r[0], max(LEAST_SALTS, -(-r["n"] // TASK_ROWS))) for r in counts.collect()]


def row_salt(df: DataFrame, tasks: Column) -> Column:
    """A number below ``tasks`` from the row's own values, so that a task that runs again gives its rows the same number."""
    plain = [F.col(f.name) if "map<" not in f.dataType.simpleString() else F.to_json(f.name) for f in df.schema]
    return F.pmod(F.xxhash64(*plain), tasks.cast("bigint")).cast("int")


def hub_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined with right, which has at most one row per key; the rows of a hub of left are spread over as many tasks as they need.

    Without a hub it is a plain join. ``rows``: rows of left, where they are known. Null keys follow ``how`` as in any
    join; where left has hubs they are spread as well. ``key`` must be the only column that both sides share.
    """
    left = left.where(F.col(key).isNotNull()) if how == "inner" else left
    hubs = hubs_of(left, key, rows)
    if not hubs:
        return left.join(right, key, how)
    spark = left.sparkSession
    kind = left.schema[key].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(hubs, f"{key} {kind}, tasks int"))
    salted = left.join(table, key, "left").withColumn("tasks", F.when(F.col(key).isNull(), LEAST_SALTS).otherwise(F.coalesce("tasks", F.lit(1))))
    salted = salted.withColumn("salt", row_salt(left, F.col("tasks"))).drop("tasks")
    wide = right.join(table, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    return salted.join(wide, [key, "salt"], how).drop("salt")
