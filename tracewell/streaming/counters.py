"""Counters of model streams: the same aggregation for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_deltas(deltas: DataFrame) -> DataFrame:
    """Chunks and characters per session and request. Sums commute, so neither the order of deltas
    nor that of a response and its stream matters."""
    chars = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("chars")).otherwise(0)).cast("long")
    return deltas.groupBy("session_id", "request_id").agg(F.count("*").alias("chunk_count"), chars("reasoning").alias("reasoning_chars"), chars("text").alias("text_chars"))


def count_since_start(deltas: DataFrame) -> DataFrame:
    """The same counters, but a row of kind ``start`` sets a call's counters back: only what came after
    its last start (by ``event_id``) counts. Calls that never started count from the beginning."""
    last = deltas.groupBy("session_id", "request_id").agg(F.max(F.when(F.col("kind") == "start", F.col("event_id"))).alias("_start"))
    rows = deltas.join(last, ["session_id", "request_id"]).where("kind <> 'start' and (_start is null or event_id > _start)")
    return count_deltas(rows.drop("_start"))


def start_counters(deltas: DataFrame, name: str, checkpoint: str, ttl: str = "30 minutes"):
    """Run :func:`count_deltas` as a streaming query into the in-memory table ``name``.

    ``deltas`` is a streaming frame with ``ts``; repeated events within the watermark are counted
    once, and what is kept to tell them goes with it. The counters themselves stay for as long as
    the query runs, as the table shows all of them: it is meant for looking at live calls.
    """
    once = deltas.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["event_id"])
    return count_deltas(once).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
