"""Windowed totals and resumable labelling; each function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_totals(rows: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Count and sum per window and keys; rows later than `late` are left out of a stream."""
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.where(F.col(time).isNotNull()).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def session_totals(rows: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Sessions of each key that end after a gap without rows."""
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.where(F.col(time).isNotNull()).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def first_loads(rows: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once; a stream forgets keys after `late`."""
    if rows.isStreaming:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)
