"""Counts of recent changes in sliding windows, over a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def recent_counts(events: DataFrame, time_col: str = "ts", window: str = "5 minutes", slide: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n); on a stream, rows later than late are dropped and state is bounded by it."""
    if events.isStreaming:
        events = events.withWatermark(time_col, late)
    spans = F.window(F.col(time_col), window) if window == slide else F.window(F.col(time_col), window, slide)
    counted = events.groupBy(spans.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")


def start_totals(events: DataFrame, name: str, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Running totals by type, complete mode, to a table in memory."""
    totals = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return (
        totals.writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )
