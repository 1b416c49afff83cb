"""Event-time windows over streams or tables: tumbling, sliding and session, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(frame: DataFrame, window: Column, by: list[str], value: str) -> DataFrame:
    out = frame.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def tumbling(events: DataFrame, ts: str, value: str, width: str = "30 seconds", late: str = "1 minute", by: list[str] = ()) -> DataFrame:
    """Count and sum of each window; rows later than `late` are dropped from a stream."""
    return _counted(events.withWatermark(ts, late), F.window(ts, width), list(by), value)


def sliding(events: DataFrame, ts: str, value: str, width: str, slide: str, late: str = "1 minute", by: list[str] = ()) -> DataFrame:
    return _counted(events.withWatermark(ts, late), F.window(ts, width, slide), list(by), value)


def sessions(events: DataFrame, ts: str, value: str, gap: str, by: list[str], late: str = "1 minute") -> DataFrame:
    """Count and sum of each run of rows of a key without a longer gap."""
    return _counted(events.withWatermark(ts, late), F.session_window(ts, gap), by, value)


def once(events: DataFrame, key: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; a stream forgets keys older than `late`."""
    marked = events.withWatermark(ts, late)
    return marked.dropDuplicatesWithinWatermark(key) if events.isStreaming else marked.dropDuplicates(key)
