"""Endpoint observations as a stream: counts per topic and time window, late ones within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topic_activity(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, name, role, n) of a stream of (ts, name, role)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "name", "role").agg(F.count("*").alias("n"))
