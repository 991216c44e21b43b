"""Streams: windowed event counts with late data, and the last progress of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by event time; with a stream the watermark bounds the state."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def last_by_key(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The newest value of each key: one keyed aggregate, so state is one row a key."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order), F.count("*").alias("events"))
