"""Streaming versions of counting and of one row per key; an extension, the batch operators are the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each key in tumbling windows; later ones than the watermark are dropped by Spark."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def running_first(events: DataFrame, keys: list[str], order: str, keep: list[str]) -> DataFrame:
    """The first row of each key so far, and the number of rows; for update or complete mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(F.struct(*keep), order).alias("first")).select(*keys, "n", "first.*")
