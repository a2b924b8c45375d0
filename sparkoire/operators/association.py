"""Sequences and clusters that go with a class: counts, exact tests, specimen features."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(rows: DataFrame, keys: list[str], label: str, classes: list[str], participant: str = "participant_label") -> DataFrame:
    """Distinct participants of each class for each key, wide, 0 filled; rows with a null key don't count."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    held = rows.where(known).select(*keys, label, participant).distinct()
    return held.groupBy(*keys).agg(*[F.sum((F.col(label) == c).cast("long")).alias(c) for c in classes])


def class_totals(rows: DataFrame, label: str, classes: list[str], participant: str = "participant_label") -> dict[str, int]:
    """Distinct participants of each class; a participant of two classes counts in both."""
    held = rows.select(label, participant).distinct().agg(*[F.sum((F.col(label) == c).cast("long")).alias(c) for c in classes]).first()
    return {c: held[c] or 0 for c in classes}


def log_factorials(n: int) -> list[float]:
    """Natural logs of 0! to n!; n is a number of participants."""
    out = [0.0]
    for i in range(1, n + 1):
        out.append(out[-1] + log(i))
    return out


def fisher_right(counts: DataFrame, totals: dict[str, int], classes: list[str], keys: list[str]) -> DataFrame:
    """Right-tail probability of each key's counts in each class, ``p_<class>``.

    Of N participants K are of the class and n hold the key; p sums the
    hypergeometric terms from the observed count up.  Distinct (x, n) pairs are
    tested once: there are far fewer of them than keys.
    """
    total = sum(totals.values())
    table = F.array(*[F.lit(v) for v in log_factorials(total)])
    logs = lambda x: F.get(table, x.cast("int"))
    n = sum((F.col(f"`{c}`") for c in classes), F.lit(0).cast("long"))
    distinct = counts.select(*[F.col(f"`{c}`") for c in classes]).distinct().withColumn("_n", n)

    def p(c):
        x, k, most = F.col(f"`{c}`"), F.lit(totals[c]).cast("long"), F.least(F.lit(totals[c]).cast("long"), F.col("_n"))
        def term(i):
            fits = F.col("_n") - i <= total - k
            log = (
                logs(k) - logs(i) - logs(k - i) + logs(total - k) - logs(F.col("_n") - i) - logs(total - k - F.col("_n") + i)
                - logs(F.lit(total)) + logs(F.col("_n")) + logs(total - F.col("_n"))
            )
            return F.when(fits, F.exp(log)).otherwise(0.0)
        return F.least(F.lit(1.0), F.aggregate(F.transform(F.sequence(x, most), term), F.lit(0.0), lambda s, v: s + v))

    tested = distinct.select(*[F.col(f"`{c}`") for c in classes], *[p(c).alias(f"p_{c}") for c in classes])
    return counts.join(tested, classes).select(*keys, *classes, *[f"p_{c}" for c in classes])


def below(scored: DataFrame, p: float, classes: list[str]) -> DataFrame:
    """Keys with p or less in some class."""
    lowest = F.least(*[F.col(f"p_{c}") for c in classes]) if len(classes) > 1 else F.col(f"p_{classes[0]}")
    return scored.where(lowest <= p)


def exact_features(rows: DataFrame, scored: DataFrame, keys: list[str], p: float, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Listed sequences for each class per 1,000 distinct sequences of a specimen; and specimens without any."""
    per_specimen = rows.select("specimen_label", *keys).distinct()
    joined = per_specimen.join(scored.select(*keys, *[f"p_{c}" for c in classes]), keys, "left")
    features = joined.groupBy("specimen_label").agg(
        *[(F.sum(F.coalesce((F.col(f"p_{c}") <= p).cast("long"), F.lit(0))) * 1000.0 / F.count("*")).alias(c) for c in classes]
    )
    any_hit = sum((F.col(f"`{c}`") for c in classes), F.lit(0.0)) > 0
    return features.where(any_hit), features.where(~any_hit).select("specimen_label")


def cluster_features(assigned: DataFrame, scored: DataFrame, cluster: str, p: float, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct listed clusters of each class that a specimen hits; and specimens that hit none."""
    hits = assigned.where(F.col(cluster).isNotNull()).select("specimen_label", cluster).distinct()
    joined = hits.join(below(scored, p, classes), cluster)
    features = joined.groupBy("specimen_label").agg(*[F.sum((F.col(f"p_{c}") <= p).cast("long")).alias(c) for c in classes])
    return features, assigned.select("specimen_label").distinct().join(features, "specimen_label", "left_anti")


def predictive(scored: DataFrame, keys: list[str], p: float, classes: list[str]) -> DataFrame:
    """Clusters below p for each class."""
    long = scored.unpivot(keys, [f"p_{c}" for c in classes], "class", "p")
    return long.where(F.col("p") <= p).groupBy(F.substring("class", 3, 1000).alias("class")).agg(F.count("*").alias("n"))


def unshared(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def hit_shares(features: DataFrame, labels: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """(label, class, hits, share): specimens of each label with a hit of each class; specimens without features have none."""
    every = labels.select("specimen_label", label).join(features, "specimen_label", "left")
    long = every.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.coalesce(F.col(f"`{c}`") > 0, F.lit(False)).cast("long").alias("hit")) for c in classes])).alias("x"))
    return long.groupBy(label, "x.class").agg(F.sum("x.hit").alias("hits"), F.avg("x.hit").alias("share"))


def counts_below(scored: DataFrame, candidates: list[float], classes: list[str]) -> DataFrame:
    """(p, class, n) for a grid of thresholds, all in one aggregate."""
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("value")) for c in classes])).alias("x")).select("x.*")
    wide = long.groupBy("class").agg(*[F.sum((F.col("value") <= p).cast("long")).alias(str(i)) for i, p in enumerate(candidates)])
    grid = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"`{i}`").alias("n")) for i, p in enumerate(candidates)])
    return wide.select("class", F.explode(grid).alias("g")).select("g.p", "class", "g.n")
