"""Feature tables of several models as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import shared_join


def prefixed(features: DataFrame, prefix: str, key: str) -> DataFrame:
    return features.select(key, *[F.col(f"`{c}`").alias(f"{prefix}:{c}") for c in features.columns if c != key])


def combine(parts: dict[str, tuple[DataFrame, DataFrame, DataFrame]], key: str = "specimen_label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, metadata, abstained) of models given as (features, metadata, abstained keys).

    Metadata are joined in full over all shared columns; a key abstains if any
    model abstains on it; features hold the keys that all models scored.
    """
    metadata = reduce(lambda a, b: shared_join(a, b, key), [m for _, m, _ in parts.values()])
    abstained = reduce(lambda a, b: a.union(b), [x.select(key) for _, _, x in parts.values()]).distinct()
    features = reduce(lambda a, b: a.join(b, key), [prefixed(f, name, key) for name, (f, _, _) in parts.items()])
    return features.join(abstained, key, "left_anti"), metadata, abstained


def in_all(parts: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    return reduce(lambda a, b: a.join(b, key, "left_semi"), [p.select(key).distinct() for p in parts])


def one_of_two(probabilities: DataFrame, classes: list[str], positive: str) -> DataFrame:
    """With two classes the second probability says nothing new."""
    return probabilities.drop(*[c for c in classes if c != positive]) if len(classes) == 2 else probabilities


def residuals(df: DataFrame, features: list[str], covariates: list[str], train: str) -> DataFrame:
    """Features less their linear regression on the covariates, fitted on rows with the train flag.

    All sums of products are one aggregate; the normal equations are solved on the driver.
    """
    import numpy as np

    x = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
    fit = df.where(F.col(train))
    sums = [F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)] + [F.sum(a * F.col(f)).alias(f"y{i}_{k}") for i, a in enumerate(x) for k, f in enumerate(features)]
    row = fit.agg(*sums).first()
    left = np.array([[row[f"x{i}_{j}"] or 0.0 for j in range(len(x))] for i in range(len(x))])
    right = np.array([[row[f"y{i}_{k}"] or 0.0 for k in range(len(features))] for i in range(len(x))])
    beta = np.linalg.lstsq(left, right, rcond=None)[0]
    fitted = lambda k: sum((a * F.lit(float(beta[i, k])) for i, a in enumerate(x)), F.lit(0.0))
    return df.select(*[c for c in df.columns if c not in features], *[(F.col(f) - fitted(k)).alias(f) for k, f in enumerate(features)])
