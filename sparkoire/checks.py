"""Joins and tables with checked properties; a check is an aggregate, no rows reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import sequence as seq


class CheckFailed(ValueError):
    """A table isn't what the caller said it is."""


def assert_unique(df: DataFrame, on: list[str], what: str = "table") -> None:
    repeated = df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise CheckFailed(f"{what}: keys {on} repeat")


def assert_none(df: DataFrame, condition: Column, message: str) -> None:
    if not df.where(condition).isEmpty():
        raise CheckFailed(message)


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str | None = None) -> DataFrame:
    """A join whose cardinality ("1:1", "m:1", "1:m") is verified first."""
    if validate not in (None, "1:1", "m:1", "1:m"):
        raise ValueError(validate)
    if validate in ("1:1", "1:m"):
        assert_unique(left, on, "left side")
    if validate in ("1:1", "m:1"):
        assert_unique(right, on, "right side")
    return left.join(right, on, how)


def checked_loss(joined: DataFrame, left: DataFrame, right: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """The joined rows, if they are at least (1 - tolerance) of the shorter side."""
    least, n = min(left.count(), right.count()), joined.count()
    if n > least or n < (1 - tolerance) * least:
        raise CheckFailed(f"joined {n} rows of {least}")
    return joined


def shared_join(left: DataFrame, right: DataFrame, key: str, how: str = "full") -> DataFrame:
    """Join on the key and all other shared columns, null equal to null; a key with contradicting columns raises."""
    shared = [c for c in left.columns if c in right.columns]
    condition = None
    for c in shared:
        one = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        condition = one if condition is None else condition & one
    joined = left.alias("l").join(right.alias("r"), condition, how)
    out = joined.select(
        *[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in shared],
        *[F.col(f"l.{c}") for c in left.columns if c not in shared],
        *[F.col(f"r.{c}") for c in right.columns if c not in shared],
    )
    if how == "full":
        assert_unique(out, [key], "joined table")
    return out


def enrich(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join over all shared columns, null equal to null; the metadata may hold a combination once."""
    shared = [c for c in df.columns if c in metadata.columns]
    assert_unique(metadata, shared, "metadata")
    return shared_join(df, metadata, shared[0], "left")


def require_all(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of the listed keys; a key without rows raises."""
    missing = keys.join(df, on, "left_anti")
    if not missing.isEmpty():
        raise CheckFailed(f"missing {on}: {[r[0] for r in missing.select(on).limit(5).collect()]}")
    return df.join(keys, on, "left_semi")


def unique_slugs(df: DataFrame, column: str, name: str = "slug") -> DataFrame:
    """File names from labels; two labels of one name raise."""
    out = df.withColumn(name, seq.slug(column))
    assert_unique(out.select(column, name).distinct(), [name], "file names")
    return out
