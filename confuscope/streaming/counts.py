"""Counting label pairs as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import KEYS


def streaming_cells(pairs: DataFrame) -> DataFrame:
    """Running counts of a streaming frame of pairs; write it in update or complete mode. The state is a row
    for each cell, which the label lists bound."""
    return pairs.groupBy(*KEYS).agg(F.count("*").cast("double").alias("n"))


def windowed_cells(pairs: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are dropped and closed windows leave the state."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return pairs.withWatermark(ts, late).groupBy(w.alias("window"), *KEYS).agg(F.count("*").cast("double").alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *KEYS, "n")


def session_pairs(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n) of a stream of (user_id, ts)."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def follow(cells: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", available_now: bool = True) -> StreamingQuery:
    """Run ``each(batch, number)`` on every update, for instance to recompute profiles of changed scripts."""
    writer = cells.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain(cells: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and read what it ends with (in complete mode the whole result). ``path``: a
    folder that driver and executors share, for the checkpoint and a table for each batch."""
    spark, last = cells.sparkSession, []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        last.append(number)

    follow(cells, keep, f"{path}/checkpoint", mode).awaitTermination()
    return spark.read.schema(cells.schema).parquet(f"{path}/batch-{last[-1]}") if last else spark.createDataFrame([], cells.schema)
