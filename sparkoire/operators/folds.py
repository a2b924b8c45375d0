"""Cross-validation folds, overlaps of sets, reproducible samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import CheckFailed


def hash_order(*columns, seed: str = "0") -> Column:
    """A reproducible random order."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(seed)))


def assign_folds(participants: DataFrame, key: str, stratum: str, k: int = 3, seed: str = "0", smaller: float = 1 / 3) -> DataFrame:
    """(key, stratum, fold_id, fold_label): each participant tests in one fold and otherwise trains or validates.

    Shares of each stratum are equal up to one.  The training set is split again
    by rank into train_smaller1, train_smaller2 and validation.  Fold -1 holds
    everyone, without a test set.
    """
    order = Window.partitionBy(stratum).orderBy(hash_order(key, seed=seed), key)
    ranked = participants.select(key, stratum).distinct().withColumn("_test", (F.row_number().over(order) - 1) % k)
    folds = ranked.withColumn("fold_id", F.explode(F.array(*[F.lit(i) for i in (*range(k), -1)])))
    training = F.col("_test") != F.col("fold_id")
    inner = Window.partitionBy(stratum, "fold_id", training).orderBy(hash_order(key, seed=seed + "i"), key)
    place = F.row_number().over(inner) / F.count("*").over(Window.partitionBy(stratum, "fold_id", training))
    label = F.when(~training, "test").when(place > 1 - smaller, "validation").when(place > (1 - smaller) * (1 - smaller), "train_smaller2").otherwise("train_smaller1")
    return folds.withColumn("fold_label", label).select(key, stratum, "fold_id", "fold_label")


def check_folds(folds: DataFrame, key: str, k: int) -> DataFrame:
    """The folds, if each participant has one label in a fold and tests exactly once."""
    twice = folds.groupBy(key, "fold_id").agg(F.count("*").alias("n")).where("n > 1")
    tests = folds.groupBy(key).agg(F.sum((F.col("fold_label") == "test").cast("long")).alias("n")).where("n != 1")
    if not twice.isEmpty() or not tests.isEmpty():
        raise CheckFailed("folds overlap")
    return folds


def inner_folds(rows: DataFrame, group: str, stratum: str, k: int = 5) -> DataFrame:
    """Stratified folds in which a group stays together."""
    groups = rows.groupBy(group).agg(F.min(stratum).alias("_s"))
    order = Window.partitionBy("_s").orderBy(hash_order(group), group)
    return rows.join(groups.withColumn("inner_fold", (F.row_number().over(order) - 1) % k).drop("_s"), group)


def capped(rows: DataFrame, group: str, cap: int, ids: list[str], seed: str = "0") -> DataFrame:
    """Groups above the cap are sampled down to it, without replacement."""
    order = Window.partitionBy(group).orderBy(hash_order(*ids, seed=seed), *ids)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).drop("_r")


def sampled(rows: DataFrame, n: int, ids: list[str], seed: str = "0") -> DataFrame:
    """n rows, the same ones each time."""
    return rows.orderBy(hash_order(*ids, seed=seed), *ids).limit(n)


def permuted_labels(donors: DataFrame, donor: str, label: str, positive: str, seed: str = "0") -> DataFrame:
    """As many donors as are positive become positive, by hash order."""
    n = donors.select(F.sum((F.col(label) == positive).cast("long")).alias("_n"))
    ranked = donors.withColumn("_r", F.row_number().over(Window.orderBy(hash_order(donor, seed=seed), donor)))  # one row per donor
    return ranked.crossJoin(F.broadcast(n)).withColumn("permuted", F.col("_r") <= F.col("_n")).drop("_r", "_n")


def jaccard(rows: DataFrame, item: list[str], owner: str) -> DataFrame:
    """(a, b, shared, jaccard) of every pair of owners a < b; owners meet by the items that they share, others are 0.

    Items that the same owners hold are counted together before pairs are made.
    Owners are few (participants, labels of folds): an item's list of them is no
    longer than their number, and each pair of them is a row of the result.
    """
    held = rows.select(*item, owner).distinct()
    sizes = held.groupBy(owner).agg(F.count("*").alias("n"))
    sets = held.groupBy(*item).agg(F.array_sort(F.collect_set(owner)).alias("_owners")).where(F.size("_owners") > 1).groupBy("_owners").agg(F.count("*").alias("_n"))
    first = sets.select("_n", "_owners", F.posexplode("_owners").alias("_at", "a"))
    met = first.select("_n", "a", F.explode(F.slice("_owners", F.col("_at") + 2, F.size("_owners"))).alias("b")).groupBy("a", "b").agg(F.sum("_n").alias("shared"))
    one, two = sizes.toDF("a", "n_a"), sizes.toDF("b", "n_b")
    pairs = one.join(two, F.col("a") < F.col("b")).join(met, ["a", "b"], "left")
    shared = F.coalesce("shared", F.lit(0).cast("long"))
    return pairs.select("a", "b", shared.alias("shared"), (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("jaccard"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def random_pairs(items: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """(a, b) of n distinct unordered pairs of keys, the same each time; without a product of all keys.

    Numbers are drawn by hash, four times as many as wanted, and looked up; too few keys give fewer pairs.
    """
    numbered = items.select(F.col(key).alias("k")).distinct().withColumn("i", (F.row_number().over(Window.orderBy("k")) - 1).cast("long"))  # a row for each key
    count = numbered.agg(F.count("*").alias("m"))
    number = lambda side: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(side), F.lit(seed))), 1, 8), 16, 10).cast("long")
    drawn = items.sparkSession.range(4 * n).crossJoin(F.broadcast(count)).where("m > 0").select("id", (number("a") % F.col("m")).alias("x"), (number("b") % F.col("m")).alias("y"))
    pairs = drawn.where("x != y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("id").alias("id")).orderBy("id").limit(n)
    left, right = numbered.select(F.col("i").alias("x"), F.col("k").alias("a")), numbered.select(F.col("i").alias("y"), F.col("k").alias("b"))
    return pairs.join(left, "x").join(right, "y").select("a", "b")
