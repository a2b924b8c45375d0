"""Per-specimen statistics of sequence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab


def frequencies(rows: DataFrame, group: list[str], value: list[str], weight: Column | None = None) -> DataFrame:
    """Share of each value in its group, counted or weighted."""
    counts = rows.groupBy(*group, *value).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    return counts.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def proportion(rows: DataFrame, left: list[str], right: list[str], flag: Column) -> DataFrame:
    """Share of rows with the flag for every combination of the distinct keys, 0 where there are no rows."""
    found = rows.groupBy(*left, *right).agg(F.avg(flag.cast("double")).alias("proportion"))
    every = rows.select(*left).distinct().crossJoin(F.broadcast(rows.select(*right).distinct()))  # right keys: a closed vocabulary
    return every.join(found, [*left, *right], "left").select(*left, *right, F.coalesce("proportion", F.lit(0.0)).alias("proportion"))


def wide(rows: DataFrame, index: list[str], column: str, values: list[str], value: Column) -> DataFrame:
    """Pivot with an explicit list of columns, absent ones made, 0 filled."""
    out = rows.groupBy(*index).pivot(column, values).agg(value)
    return out.select(*index, *[F.coalesce(F.col(f"`{v}`").cast("double"), F.lit(0.0)).alias(v) for v in values])


def normalised(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """Rows divided by their sum; all-zero rows stay zero."""
    total = sum((F.col(f"`{c}`") for c in columns), F.lit(0.0))
    return matrix.select(*[c for c in matrix.columns if c not in columns], *[F.coalesce(F.col(f"`{c}`") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])


def weighted_median(rows: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """The smallest value with half of the weight up to it; the mean of two where it is exactly half."""
    order = Window.partitionBy(*group).orderBy(value)
    per_value = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(weight).alias("w"))
    running = per_value.withColumn("upto", F.sum("w").over(order)).withColumn("all", F.sum("w").over(Window.partitionBy(*group))).withColumn("after", F.lead(value).over(order))
    hit = running.where((F.col("upto") >= F.col("all") / 2) & (F.col("upto") - F.col("w") < F.col("all") / 2))
    exact = F.col("upto") == F.col("all") / 2
    return hit.select(*group, F.when(exact & F.col("after").isNotNull(), (F.col(value) + F.col("after")) / 2).otherwise(F.col(value)).alias("weighted_median"))


def composition(rows: DataFrame, isotypes: list[str], pairs: list[str]) -> DataFrame:
    """A specimen's features: median mutation rate and mutated share by isotype, V-J frequencies by isotype."""
    stats = rows.groupBy("specimen_label").agg(
        *[F.median(F.when(F.col("isotype_supergroup") == i, F.col("v_mut"))).alias(f"{i}:v_mut_median") for i in isotypes],
        *[F.coalesce(F.avg(F.when(F.col("isotype_supergroup") == i, (F.col("v_mut") >= vocab.MUTATED_FROM).cast("double"))), F.lit(0.0)).alias(f"{i}:mutated") for i in isotypes],
    )
    pair = F.concat_ws("|", "v_gene", "j_gene")
    share = frequencies(rows.withColumn("pair", F.concat_ws(":", "isotype_supergroup", pair)), ["specimen_label", "isotype_supergroup"], ["pair"])
    matrix = wide(share, ["specimen_label"], "pair", [f"{i}:{p}" for i in isotypes for p in pairs], F.sum("frequency"))
    for i in isotypes:
        matrix = normalised(matrix, [f"{i}:{p}" for p in pairs])
    return stats.join(matrix, "specimen_label")


def common_genes(rows: DataFrame, gene: str, label: str) -> DataFrame:
    """Genes whose largest frequency within a class reaches the median over genes."""
    top = frequencies(rows, [label], [gene]).groupBy(gene).agg(F.max("frequency").alias("top"))
    return top.crossJoin(F.broadcast(top.agg(F.median("top").alias("cut")))).where(F.col("top") >= F.col("cut")).select(gene, "top")
