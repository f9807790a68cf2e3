"""Event-time runs: the analogue of contiguous frame runs on timestamps, for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int, late_seconds: int | None = None) -> DataFrame:
    """(key, started, ended, n) of runs whose gaps stay below ``gap_seconds`` [O-99, O-158].

    With ``late_seconds`` the events are a stream: a watermark closes sessions and drops later events.
    """
    e = events if late_seconds is None else events.withWatermark(time, f"{late_seconds} seconds")
    s = e.groupBy(key, F.session_window(time, f"{gap_seconds} seconds").alias("w"))
    return s.agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count(F.lit(1)).alias("n")).drop("w")


def windows(events: DataFrame, time: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts per tumbling or sliding window."""
    e = events if late is None else events.withWatermark(time, late)
    return e.groupBy(F.window(time, size, slide) if slide else F.window(time, size)).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "n")
