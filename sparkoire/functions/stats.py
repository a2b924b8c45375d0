"""Column builders for weights, entropies and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col


def entropy(probabilities: list) -> Column:
    """Natural-log entropy of a row's scores, normalised first; zero scores add nothing."""
    total = sum((col(p) for p in probabilities), F.lit(0.0))
    share = [col(p) / F.nullif(total, F.lit(0.0)) for p in probabilities]
    return sum((F.when(s > 0, -s * F.ln(s)).otherwise(F.lit(0.0)) for s in share), F.lit(0.0))


def entropy_cutoff(classes: int, factor: float = 0.9) -> float:
    """A share of the largest entropy."""
    return factor * math.log(classes)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclidean(a, b) -> Column:
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), square), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a, b) -> Column:
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
