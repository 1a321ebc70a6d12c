"""Streaming forms of the batch operators (an extension: batch inputs are bounded).

Each takes a streaming frame with an event-time column and returns one;
late rows are bounded by the watermark, and so is the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, started, ended, n_events) of sessions that end after a gap."""
    s = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_events"))
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def windows(events: DataFrame, key: str, ts: str, value: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """(key, started, n, mean_value) of tumbling windows, or of sliding ones."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))
    return g.select(key, F.col("w.start").alias("started"), "n", "mean_value")


def dedup(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
