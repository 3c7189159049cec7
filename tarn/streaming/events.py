"""Windows over event tables and streams; an extension beyond evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum of values in tumbling or sliding windows by type; ``late`` is the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.groupBy(w.alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Count and sum of values in sessions of each user that end after ``gap`` without an event."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("session_window"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
