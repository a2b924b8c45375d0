"""Read-level operations: demultiplexing, primers, isotype calls, replicates, mutation tracks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..storage import Scratch


def demultiplex(reads: DataFrame, barcodes: DataFrame, start: int, length: int, sequence: str = "sequence") -> DataFrame:
    """Reads with the barcode pair whose forward part stands at the start and whose reverse part at the end."""
    s = F.col(sequence)
    sliced = reads.withColumn("forward", F.substring(s, start + 1, length)).withColumn("reverse", F.substring(seq.reverse_complement(s), start + 1, length))
    return sliced.join(F.broadcast(barcodes), ["forward", "reverse"])  # a plate's barcodes


def trimmed_of_barcode(s: Column, start: int, length: int) -> Column:
    return F.substring(s, F.lit(start + length + 1), F.length(s) - 2 * (start + length))


def one_mismatch(primer: str) -> str:
    """Pattern of the primer with any one base."""
    return "|".join(primer[:i] + "." + primer[i + 1 :] for i in range(len(primer)))


def trim_primers(reads: DataFrame, forward: str, reverse: str, tolerance: int, least: int, sequence: str = "sequence") -> DataFrame:
    """``trimmed``: what stands between the primers, exact ones first, then with one mismatch; too short is null.

    The forward primer must begin within the tolerance of the start, the reverse
    one end within it of the end.
    """
    def between(f, r):
        return F.regexp_extract(F.col(sequence), f"^.{{0,{tolerance}}}?(?:{f})(.*)(?:{r}).{{0,{tolerance}}}$", 1)

    exact, loose = between(forward, reverse), between(one_mismatch(forward), one_mismatch(reverse))
    found = F.when(exact != "", exact).otherwise(loose)
    return reads.withColumn("trimmed", F.when(F.length(found) >= least, found))


def isotype_call(reads: DataFrame, upstream: list[tuple[str, str]], tolerance: int, sequence: str = "sequence") -> DataFrame:
    """The first listed isotype whose upstream sequence stands within the tolerance of the read's end."""
    call = F.lit(None).cast("string")
    for motif, isotype in reversed(upstream):
        call = F.when(F.right(F.col(sequence), F.lit(len(motif) + tolerance)).contains(motif), isotype).otherwise(call)
    return reads.withColumn("isosubtype", call)


#: Rows up to which a counted list is broadcast.
SMALL = 100_000


def _mer_sets(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, mers, n): the n distinct k-mers of all sequences of a key, in order and written without a gap."""
    mers = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("sequence"), lambda s: seq.kmers(s, k)))))
    sets = df.where(F.col(key).isNotNull()).groupBy(key).agg(mers.alias("mers")).where(F.size("mers") > 0)
    return sets.select(key, F.array_join("mers", "").alias("mers"), F.size("mers").alias("n"))


def _mers(k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("mers", i * k + 1, F.lit(k)))


def _supersets(queries: DataFrame, references: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, lower): the least reference, below the one found for a query if there is one, whose larger set holds all of the query's k-mers.

    Such a reference has the query's rarest k-mer, so only those that have it are compared.
    """
    counts = references.select(F.explode(_mers(k)).alias("mer")).groupBy("mer").agg(F.count("*").alias("uses"))
    asked = queries.select("query_id", F.explode(_mers(k)).alias("mer")).join(counts, "mer", "left")
    rarest = asked.groupBy("query_id").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "mer")).alias("least"))
    chosen = scratch.cut(rarest.where("least.uses > 0").join(queries, "query_id").select("query_id", F.col("least.mer").alias("mer"), F.col("ref_id").alias("found"), F.col("n").alias("asked")))
    holders = references.select("ref_id", "n", F.explode(_mers(k)).alias("mer"))
    few = chosen.limit(SMALL + 1).count() <= SMALL
    met = holders.join(F.broadcast(chosen) if few else chosen.hint("merge"), "mer").where((F.col("n") > F.col("asked")) & (F.col("found").isNull() | (F.col("ref_id") < F.col("found"))))
    pairs = met.select("query_id", "ref_id").join(references.select("ref_id", _mers(k).alias("theirs")).hint("merge"), "ref_id").join(queries.select("query_id", _mers(k).alias("ours")).hint("merge"), "query_id")
    return pairs.where(F.size(F.array_except("ours", "theirs")) == 0).groupBy("query_id").agg(F.min("ref_id").alias("lower"))


def kmer_best_hit(queries: DataFrame, references: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, ref_id, shared): the reference with most distinct k-mers in common; ties go to the least id.

    Equal sets are compared once, under their least id.  A query whose whole set is
    in a reference can't do better: equal sets meet by their k-mers written out, larger
    ones by the query's rarest k-mer.  Only for the other queries are the shared
    k-mers counted with every reference that has any.  Rows without an id are left out.
    """
    scratch = Scratch(queries.sparkSession, "kmers")
    named, listed = _mer_sets(queries, "query_id", k), _mer_sets(references, "ref_id", k)
    refs = scratch.cut(listed.groupBy("mers", "n").agg(F.min("ref_id").alias("ref_id")))
    asked = named.groupBy("mers", "n").agg(F.min("query_id").alias("query_id"))
    equal = scratch.cut(asked.join(refs.hint("merge"), ["mers", "n"], "left"))
    most = refs.agg(F.max("n")).first()[0] or 0
    larger = _supersets(equal.where(F.col("n") < most), refs, k, scratch)
    whole = scratch.cut(equal.join(larger.hint("merge"), "query_id", "left").select("query_id", "mers", "n", F.coalesce("lower", "ref_id").alias("ref_id")))
    rest, out = whole.where("ref_id IS NULL"), whole.where("ref_id IS NOT NULL").select("mers", "ref_id", F.col("n").cast("long").alias("shared"))
    if not rest.isEmpty():
        met = rest.select("query_id", F.explode(_mers(k)).alias("mer")).join(refs.select("ref_id", F.explode(_mers(k)).alias("mer")).hint("merge"), "mer")
        best = met.groupBy("query_id", "ref_id").agg(F.count("*").alias("shared")).groupBy("query_id").agg(F.min(F.struct((-F.col("shared")).alias("less"), "ref_id")).alias("best"))
        out = out.unionByName(scratch.cut(rest.select("query_id", "mers").join(best.hint("merge"), "query_id").select("mers", "best.ref_id", (-F.col("best.less")).alias("shared"))))
    scratch.drop(refs, equal)
    return named.join(out.hint("merge"), "mers").select("query_id", "ref_id", "shared")


def attribute_columns(things: DataFrame, attributes: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Attributes (key, name, value) as columns, by one left join each."""
    for name in names:
        one = attributes.where(F.col("name") == name).select(key, F.col("value").alias(name))
        things = things.join(one, key, "left")
    return things


def select_by(df: DataFrame, **chosen: list | None) -> DataFrame:
    """Rows by exactly one selector, column=values."""
    given = {c: v for c, v in chosen.items() if v}
    if len(given) != 1:
        raise ValueError("exactly one selector is needed")
    column, values = next(iter(given.items()))
    return df.where(F.col(column).isin(*values))


def in_all_sets(df: DataFrame, sets: DataFrame, key: str, names: list[str], set_col: str = "set_name") -> DataFrame:
    """Rows whose key is a member of every named set."""
    return reduce(lambda d, n: d.join(sets.where(F.col(set_col) == n).select(key), key, "left_semi"), names, df)


def not_spam(df: DataFrame, limit: float, score: str = "spam_score") -> DataFrame:
    return df.where(F.coalesce(F.col(score) <= limit, F.lit(True)))


def coincidence(rows: DataFrame, item: str, replicate: str, weight: str | None = None, order: int = 2) -> DataFrame:
    """Sum over items of products of their counts in ``order`` different replicates, over the same sum of products of the replicates' totals.

    The elementary symmetric sums come from power sums, one aggregate an item; replicates aren't joined with each other.
    """
    counts = rows.groupBy(item, replicate).agg((F.count("*") if weight is None else F.sum(weight)).cast("double").alias("x"))

    def symmetric(x: str, prefix: str) -> list[Column]:
        return [F.sum(F.pow(F.col(x), F.lit(k))).alias(f"{prefix}{k}") for k in range(1, order + 1)]

    def newton(prefix: str) -> Column:
        e = [F.lit(1.0)]
        for k in range(1, order + 1):
            e.append(sum((F.lit((-1.0) ** (i - 1)) * e[k - i] * F.col(f"{prefix}{i}") for i in range(1, k + 1)), F.lit(0.0)) / k)
        return e[order]

    top = counts.groupBy(item).agg(*symmetric("x", "p")).agg(F.sum(newton("p")).alias("numerator"))
    sizes = counts.groupBy(replicate).agg(F.sum("x").alias("n")).agg(*symmetric("n", "q")).select(newton("q").alias("denominator"))
    return top.crossJoin(sizes).select("numerator", "denominator", (F.col("numerator") / F.nullif("denominator", F.lit(0.0))).alias("score"))


def mutation_track(rows: DataFrame, query: str, germline: str, group: list[str], places: int) -> DataFrame:
    """Mutated and compared bases at each place of aligned sequences."""
    cells = rows.select(*group, F.posexplode(F.arrays_zip(seq.residues(query).alias("q"), seq.residues(germline).alias("g"))).alias("at", "c"))
    compared = F.col("c.q").isin("A", "C", "G", "T") & F.col("c.g").isin("A", "C", "G", "T")
    return cells.where((F.col("at") < places) & compared).groupBy(*group, "at").agg(F.sum((F.col("c.q") != F.col("c.g")).cast("long")).alias("mutated"), F.count("*").alias("compared"))


def hotspots(rows: DataFrame, sequence: str, motifs: list[str], group: list[str]) -> DataFrame:
    """Occurrences of each motif, overlapping ones too."""
    equals = lambda m: lambda x: x == F.lit(m)
    counts = [F.size(F.filter(seq.kmers(sequence, len(m)), equals(m))) for m in motifs]
    return rows.groupBy(*group).agg(*[F.sum(c).cast("long").alias(m) for m, c in zip(motifs, counts, strict=True)])


def junctions(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: mean and median identity, mean N1 and N2 length, mean bases chewed back from V, D (both ends) and J.

    N1 lies between V and D, N2 between D and J, in places of the read; overlaps
    count as 0.  What a gene lost is what its germline has beyond the aligned part.
    """
    between = lambda a, b: F.greatest(F.col(b) - F.col(a) - 1, F.lit(0))
    lost = {"v": F.col("v_germline_length") - F.col("v_germline_end"), "d5": F.col("d_germline_start") - 1, "d3": F.col("d_germline_length") - F.col("d_germline_end"), "j": F.col("j_germline_start") - 1}
    return rows.groupBy(*group).agg(
        F.avg("identity").alias("mean_identity"), F.median("identity").alias("median_identity"),
        F.avg(between("v_end", "d_start")).alias("n1"), F.avg(between("d_end", "j_start")).alias("n2"), *[F.avg(x).alias(f"chewed_{n}") for n, x in lost.items()],
    )
