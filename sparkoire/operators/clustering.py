"""Sequence clusters within blocks of equal genes and length, their consensus, and assignment to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as seq
from .graph import connected, cut


def most_mismatches(length: Column, identity: float) -> Column:
    """Most places that may differ: m / length <= 1 - identity, in doubles as the rule is stated."""
    limit = F.lit(1.0 - identity)
    return F.size(F.filter(F.sequence(F.lit(0).cast("long"), length.cast("long")), lambda m: m / length <= limit)) - 1


def legacy_mismatches(length: Column, identity: float) -> Column:
    """The older rule, in whole mismatches."""
    return F.floor(length - identity * length).cast("int")


def near_pairs(distinct: DataFrame, keys: list[str], sequence: str, identity: float, rule=most_mismatches) -> DataFrame:
    """Pairs a < b within a block and the mismatch limit.

    A sequence with k mismatches at most shares one of k + 1 pieces unchanged, so
    pairs meet by an equi-join on (block, piece) and blocks aren't squared.
    """
    n = F.length(sequence)
    cut_up = distinct.where(n > 0).withColumn("_k", rule(n, identity)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    low, high = F.floor(F.col("_i") * n / (F.col("_k") + 1)), F.floor((F.col("_i") + 1) * n / (F.col("_k") + 1))
    pieces = cut_up.select(*keys, F.col(sequence), "_k", "_i", n.alias("_n"), F.substring(sequence, (low + 1).cast("int"), (high - low).cast("int")).alias("_piece"))
    on = [*keys, "_n", "_i", "_piece"]
    pairs = pieces.withColumnRenamed(sequence, "a").join(pieces.drop("_k").withColumnRenamed(sequence, "b"), on).where("a < b")
    near = pairs.where((F.col("_k") == 0) | (F.col("a") == F.col("b")) | (seq.hamming("a", "b") <= F.col("_k")))
    return near.select(*keys, "a", "b").distinct()


def pairwise(distinct: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """(keys, a, b, distance, share) of all pairs a < b of a block: the block's whole distance matrix, for blocks that are known to be small."""
    pairs = distinct.withColumnRenamed(sequence, "a").join(distinct.withColumnRenamed(sequence, "b"), keys).where("a < b")
    return pairs.select(*keys, "a", "b", seq.hamming("a", "b").alias("distance"), seq.normalised_hamming("a", "b").alias("share"))


def cluster(rows: DataFrame, keys: list[str], sequence: str, identity: float, rule=most_mismatches) -> DataFrame:
    """Rows with ``cluster``, the least sequence of their single-linkage cluster: cutting the tree at a distance leaves connected components.

    Only distinct sequences of a block are compared.  Rows with a null key or
    sequence are left out.
    """
    known = F.col(sequence).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    # Numbers stand for sequences while components are found: they are written with the rows, so they stay as they are.
    distinct = cut(rows.where(known).select(*keys, sequence).distinct().withColumn("_id", F.monotonically_increasing_id()))
    ids = [*keys, sequence]
    pairs = near_pairs(distinct.drop("_id"), keys, sequence, identity, rule)
    number = lambda side: distinct.select(*keys, F.col(sequence).alias(side), F.col("_id").alias(f"_{side}"))
    edges = pairs.join(number("a"), [*keys, "a"]).join(number("b"), [*keys, "b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    linked = distinct.join(connected(edges).withColumnRenamed("id", "_id"), "_id", "left").withColumn("_root", F.coalesce("root", "_id"))
    least = linked.groupBy("_root").agg(F.min(sequence).alias("cluster"))
    found = cut(linked.join(least, "_root").select(*ids, "cluster"))
    return rows.join(found, ids)


def numbered_clones(rows: DataFrame, keys: list[str], sequence: str, identity: float, person: str) -> DataFrame:
    """Clones of each person as dense numbers from 0, in the order of keys, length and least sequence."""
    out = cluster(rows, [person, *keys], sequence, identity)
    order = Window.partitionBy(person).orderBy(*keys, F.length(sequence), "cluster")
    return out.withColumn("igh_or_tcrb_clone_id", (F.dense_rank().over(order) - 1).cast("long"))


def consensus(clustered: DataFrame, keys: list[str], sequence: str, weight: str | None = None) -> DataFrame:
    """The residue of most weight at each place of a cluster; of equal ones the least.

    Equal sequences of a cluster are added up before they are taken apart.
    """
    w = F.count("*").cast("double") if weight is None else F.sum(weight).cast("double")
    distinct = clustered.groupBy(*keys, sequence).agg(w.alias("w"))
    cells = distinct.select(*keys, "w", F.posexplode(F.split(sequence, "")).alias("at", "residue"))
    votes = cells.groupBy(*keys, "at", "residue").agg(F.sum("w").alias("w"))
    best = votes.groupBy(*keys, "at").agg(F.min_by("residue", F.struct(-F.col("w"), "residue")).alias("residue"))
    letters = F.transform(F.array_sort(F.collect_list(F.struct("at", "residue"))), lambda x: x["residue"])  # as long as a sequence
    return best.groupBy(*keys).agg(F.array_join(letters, "").alias("consensus"))


def assign(rows: DataFrame, centroids: DataFrame, keys: list[str], sequence: str, identity: float) -> DataFrame:
    """Rows with the nearest centroid of their block: ``nearest``, ``distance``, and ``assigned`` if it is within 1 - identity.

    Distinct sequences are compared, ties go to the least cluster; without a
    centroid of the same keys and length all three are null.
    """
    distinct = rows.select(*keys, sequence).distinct()
    near = (
        distinct.withColumn("_n", F.length(sequence)).join(centroids.select(*keys, "cluster", F.col("consensus"), F.length("consensus").alias("_n")), [*keys, "_n"])
        .withColumn("_d", seq.normalised_hamming(sequence, "consensus"))
        .groupBy(*keys, sequence).agg(F.min(F.struct("_d", "cluster")).alias("_best"))
    )
    found = near.select(*keys, sequence, F.col("_best.cluster").alias("nearest"), F.col("_best._d").alias("distance"))
    limit = F.lit(1.0 - identity)
    return rows.join(found, [*keys, sequence], "left").withColumn("assigned", F.when(F.col("distance") <= limit, F.col("nearest")))


def proximity(distance: str = "distance") -> Column:
    return 1 - F.coalesce(F.col(distance), F.lit(1.0))


def reference_clusters(references: DataFrame, keys: list[str], sequence: str, identity: float) -> DataFrame:
    """Clusters of a reference database with their consensus."""
    clustered = cluster(references, keys, sequence, identity)
    return consensus(clustered, [*keys, "cluster"], sequence)
