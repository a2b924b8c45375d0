"""Lineage cuts and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, so that iterations don't grow the plan."""
    return Scratch(df.sparkSession, "graph").cut(df)


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of the component of each id that an edge (a, b) has.

    Each round lets every id hear the least label around it and then its label's
    label, so paths shrink by half; ids without edges aren't carried along.  Only
    whether anything changed comes to the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("root")))
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("heard"))
        lower = labels.join(heard, labels["id"] == heard["a"]).select("id", "root", F.least("root", "heard").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("root").alias("further"))
        moved = cut(lower.join(jump, "next").select("id", "root", F.least("next", "further").alias("next")))
        labels = moved.select("id", F.col("next").alias("root"))
        if moved.where("root != next").isEmpty():
            return labels
