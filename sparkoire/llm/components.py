"""Connected components over edge frames, nothing collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable, for each id of an edge (a, b).

    Alternates the large-star and small-star steps, which shrink any graph to
    stars in a logarithmic number of rounds; each round is cut and only the
    number of changed edges comes to the driver.  A hub's edges are aggregated
    by minimum before they are shuffled.  Null ends and loops are ignored.
    """
    cur = scratch.cut(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b")).distinct()
        )
        nxt = scratch.cut(small)
        n, m = cur.count(), nxt.count()
        changed = n != m or nxt.join(cur, ["a", "b"], "left_anti").limit(1).count()
        scratch.drop(cur)
        cur = nxt
        if not changed:
            break
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
