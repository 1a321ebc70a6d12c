"""Spark sessions with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tracklens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """AQE with skew joins on, UTC, ANSI; on a cluster shuffle partitions are left to AQE's coalescing of the given number."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
