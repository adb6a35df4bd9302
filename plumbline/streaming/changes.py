"""Structured Streaming over changes: late-tolerant windows, and a running state of keys by exactly-once merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.snapshots import latest


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """(start, key, n, total) of tumbling windows over ``ts``; rows later than the watermark do not count."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions of each user that end after a gap."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def merge_state(state: DataFrame | None, batch: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The latest row of each key over the state and a batch; late rows do not overtake newer ones."""
    rows = batch.select(*keys, order, *values)
    rows = rows if state is None else rows.unionByName(state.select(*keys, order, *values))
    best = latest(rows.withColumn("_o", F.col(order)), keys, "_o", [order, *values])
    return best.select(*keys, order, *values)


def follow(spark: SparkSession, source: DataFrame, folder: str, checkpoint: str, keys: list[str], order: str, values: list[str], then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps ``folder``/v-N as the state after batch N. A batch that is run again after a failure writes the same version, so
    every change counts once; version N - 1 is never touched while N is written."""

    def commit(batch: DataFrame, n: int) -> None:
        before = spark.read.parquet(f"{folder}/v-{n - 1}") if n else None
        merge_state(before, batch, keys, order, values).write.mode("overwrite").parquet(f"{folder}/v-{n}")
        if then:
            then(spark.read.parquet(f"{folder}/v-{n}"), n)

    return source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
