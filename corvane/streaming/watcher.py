"""Watching for changes with Structured Streaming, and event-time aggregates as extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators.incremental import diff


def watch(stream: DataFrame, state: str, on_change: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Starts a query over a stream of snapshot rows (path, mtime): each micro-batch is a snapshot, its difference to the last goes to ``on_change``, then it becomes the state.

    The state is written to the folder ``state`` under the batch's number before the
    pointer moves on, so a batch that is repeated after a failure sees the same former
    state. The first snapshot reports everything as added.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        old = _state(spark, state, n - 1)
        batch.write.mode("overwrite").parquet(f"{state}/{n}")
        on_change(diff(spark.read.parquet(f"{state}/{n}"), old if old is not None else batch.limit(0)), n)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def complete(aggregated: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query over what a stream holds now; ``sink`` gets the whole aggregate after each micro-batch, with its number. A batch that is repeated gives the same rows."""
    return aggregated.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _state(spark: SparkSession, state: str, n: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{n}")
    return spark.read.parquet(f"{state}/{n}") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) in tumbling or sliding windows of event time."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, finish, n): a user's sessions."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")
