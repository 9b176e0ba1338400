"""Structured Streaming forms of the mate buffer and of windowed counts over events.

The engine's inputs are finite; these are the same operators for inputs that grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """A stream gets a watermark, for which its time must be an instant."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay) if rows.isStreaming else rows


def stream_mates(ends: DataFrame, key: str = "name", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Pairs of end 0 and end 1 of each name that arrive within ``delay``; state beyond the watermark is dropped."""
    marked = _timed(ends, time, delay)
    one = marked.where("read_end = 0").select(F.col(key), F.col(time).alias("ts_1"), F.col("value").alias("value_1"))
    two = marked.where("read_end = 1").select(F.col(key).alias("_k"), F.col(time).alias("ts_2"), F.col("value").alias("value_2"))
    near = (F.col(key) == F.col("_k")) & (F.col("ts_2") >= F.col("ts_1") - F.expr(f"interval {delay}")) & (F.col("ts_2") <= F.col("ts_1") + F.expr(f"interval {delay}"))
    return one.join(two, near).drop("_k")


def window_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Count and sum of each event type in tumbling windows; late rows beyond the watermark are dropped when streaming."""
    rows = _timed(events, time, delay)
    return rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
