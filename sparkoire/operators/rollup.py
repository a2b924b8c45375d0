"""Sequence scores rolled up to specimens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .composition import weighted_median


def weighted_mean(scores: DataFrame, group: list[str], classes: list[str], weight: str) -> DataFrame:
    return scores.groupBy(*group).agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(c) for c in classes])


def trimmed(scores: DataFrame, group: list[str], classes: list[str], weight: str, proportion: float, ties: list[str], both: bool = True) -> DataFrame:
    """Weighted means of each class after the lowest (and highest) floor(proportion * n) scores are left out.

    Trimmed on both sides, the means are divided by their sum.
    """
    every = Window.partitionBy(*group)
    ranked = scores
    for c in classes:
        ranked = ranked.withColumn(f"_{c}", F.row_number().over(every.orderBy(c, *ties)))
    ranked = ranked.withColumn("_n", F.count("*").over(every)).withColumn("_cut", F.floor(F.lit(proportion) * F.col("_n")))
    means = []
    for c in classes:
        kept = F.col(f"_{c}") > F.col("_cut")
        if both:
            kept = kept & (F.col(f"_{c}") <= F.col("_n") - F.col("_cut"))
        means.append((F.sum(F.when(kept, F.col(c) * F.col(weight))) / F.sum(F.when(kept, F.col(weight)))).alias(c))
    out = ranked.groupBy(*group).agg(*means)
    if not both:
        return out
    total = sum((F.col(c) for c in classes), F.lit(0.0))
    return out.select(*group, *[(F.col(c) / total).alias(c) for c in classes])


def confident_mean(scores: DataFrame, group: list[str], classes: list[str], weight: str, factor: float = 0.9) -> DataFrame:
    """Weighted means of the scores whose entropy is below the cutoff; equal shares where none is."""
    sure = stats.entropy(classes) < stats.entropy_cutoff(len(classes), factor)
    w = F.when(sure, F.col(weight))
    return scores.groupBy(*group).agg(*[F.coalesce(F.sum(F.col(c) * w) / F.sum(w), F.lit(1.0 / len(classes))).alias(c) for c in classes])


def medians(scores: DataFrame, group: list[str], classes: list[str], weight: str) -> DataFrame:
    out = None
    for c in classes:
        one = weighted_median(scores, group, c, weight).withColumnRenamed("weighted_median", c)
        out = one if out is None else out.join(one, group)
    return out


def scored_rows(scores: DataFrame, classes: list[str]) -> DataFrame:
    """Rows with scores; rows where just some are null raise."""
    some = F.coalesce(*[F.col(c) for c in classes]).isNotNull()
    broken = F.lit(False)
    for c in classes:
        broken = broken | F.col(c).isNull()
    first = F.when(some & broken, F.raise_error(F.lit("scores are partly null")).cast("double")).otherwise(F.col(classes[0]))
    return scores.where(some).withColumn(classes[0], first)


def rollup_matrix(means: DataFrame, split: Column, splits: list[str], classes: list[str]) -> DataFrame:
    """One row for each specimen, a column "class|split" for each pair; null where the specimen has no such rows."""
    pivoted = means.withColumn("_split", split).groupBy("specimen_label").pivot("_split", splits).agg(*[F.first(c).alias(c) for c in classes])
    names = [(f"{s}_{c}" if len(classes) > 1 else s, f"{c}|{s}") for s in splits for c in classes]
    return pivoted.select("specimen_label", *[F.col(f"`{a}`").alias(b) for a, b in names])


def reweighed(matrix: DataFrame, frequencies: DataFrame, splits: list[str], classes: list[str], centre: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Missing cells filled with 1 / classes, standardised, then multiplied by the split's share of the specimen."""
    joined = matrix.join(frequencies, "specimen_label", "left")
    out = [F.col("specimen_label")]
    for s in splits:
        for c in classes:
            name = f"{c}|{s}"
            value = F.coalesce(F.col(f"`{name}`"), F.lit(1.0 / len(classes)))
            if centre:
                mean, deviation = centre[name]
                value = (value - mean) / (deviation or 1.0)
            out.append((value * F.coalesce(F.col(f"`{s}`"), F.lit(0.0))).alias(name))
    return joined.select(*out)


def standardisation(matrix: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, to be applied to other rows."""
    row = matrix.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def by_person(scores: DataFrame, person: str, classes: list[str], label: str, order: str) -> DataFrame:
    """Mean scores of a person and the first label."""
    return scores.groupBy(person).agg(*[F.avg(c).alias(c) for c in classes], F.min_by(label, order).alias(label))
