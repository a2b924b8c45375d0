"""Ordered operations within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(group: list[str], order: list) -> Window:
    return Window.partitionBy(*group).orderBy(*order)


def first_n(df: DataFrame, group: list[str], order: list, n: int = 1) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(_window(group, order))).where(F.col("_r") <= n).drop("_r")


def closest(df: DataFrame, group: list[str], value: str, target: float, low: float, high: float, ties: list, allowed: Column | None = None) -> DataFrame:
    """The row of each group whose value in low..high is closest to the target."""
    rows = df.where(F.col(value).between(low, high))
    return first_n(rows if allowed is None else rows.where(allowed), group, [F.abs(F.col(value) - target), *ties])


def group_numbers(df: DataFrame, starts: Column, group: list[str], order: list, name: str = "group_id") -> DataFrame:
    """Number of group starts so far."""
    w = _window(group, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(starts.cast("long")).over(w))


def filled(df: DataFrame, column: str, group: list[str], order: list, name: str | None = None) -> DataFrame:
    """Missing values take the next known one of the group, else the one before."""
    w = _window(group, order)
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name or column, F.coalesce(after, before))


def previous(df: DataFrame, column: str, group: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(_window(group, order)))


def one_value(df: DataFrame, group: list[str], column: str, name: str = "single") -> DataFrame:
    """Whether a group has one distinct value."""
    w = Window.partitionBy(*group)
    return df.withColumn(name, F.min(column).over(w).eqNullSafe(F.max(column).over(w)))


def codes(df: DataFrame, columns: list[str], group: list[str], name: str = "code") -> DataFrame:
    """Dense numbers from 0 of sorted keys."""
    return df.withColumn(name, F.dense_rank().over(_window(group, columns)) - 1)


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of all, as a report: each task keeps n."""
    return df.orderBy(*order).limit(n)


def backfilled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values take the next known one to their right in the row."""
    return df.withColumns({c: F.coalesce(*columns[i:]) if i + 1 < len(columns) else F.col(c) for i, c in enumerate(columns)})


def propagated(df: DataFrame, chosen: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whether a row's time point is the chosen one; all rows of it are marked."""
    marks = chosen.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marks, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
