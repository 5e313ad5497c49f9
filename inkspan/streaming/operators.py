"""Streams: tumbling rate limits, sliding counts, idle sessions. Keyed state machines are in ``sessions``.

Every function takes a streaming (or batch) frame and returns one; sources, sinks and triggers are the caller's.
Late rows beyond the watermark are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_windows(calls: DataFrame, key: str = "provider", limit: int = 300, late: str = "2 minutes") -> DataFrame:
    """Calls per key and minute and whether they pass the limit. calls: key, ts timestamp."""
    w = F.window("ts", "1 minute")
    return calls.withWatermark("ts", late).groupBy(w, key).agg(F.count("*").alias("calls")).select(F.col("window.start").alias("minute"), key, "calls", (F.col("calls") > limit).alias("limited"))


def sliding_counts(events: DataFrame, key: str, width: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width, slide)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def idle_sessions(events: DataFrame, key: str = "session_id", gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Sessions that end by inactivity: key, first and last activity, rows."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count("*").alias("n"), F.max("ts").alias("last_active_at")).select(key, F.col("session_window.start").alias("started_at"), "last_active_at", "n")
