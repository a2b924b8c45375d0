"""From reads to one sequence per clone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import assert_none
from ..functions import sequence as seq
from ..functions import vocab
from ..schema import REGIONS


def on_whitelist(reads: DataFrame, whitelist: DataFrame, keys: list[str], overrides: list[str] = ()) -> DataFrame:
    """Reads of listed specimens with the list's columns; override columns take precedence."""
    return vocab.overridden(reads.join(whitelist, keys), list(overrides))


def of_run(reads: DataFrame, flag: str, runs: list[str]) -> DataFrame:
    """Rows with the cohort flag set must come from one of the runs."""
    return reads.where(~F.col(flag) | F.col("run_label").isin(*runs))


def functional(reads: DataFrame, locus: str) -> DataFrame:
    """Productive reads with an isotype and a V score above the locus's cut."""
    return reads.where(F.col("productive") & F.col("extracted_isotype").isNotNull() & (F.col("v_score") > vocab.V_SCORE_ABOVE[locus]))


def require_locus(reads: DataFrame, locus: str) -> DataFrame:
    assert_none(reads, F.col("amplification_locus") != locus, f"rows of another locus than {locus}")
    return reads


def complete(reads: DataFrame) -> DataFrame:
    """Rows with V and J genes and every region, of amino acids alone."""
    regions = [f"{r}_seq_aa_q_trim" for r in REGIONS]
    valid = F.lit(True)
    for r in regions:
        valid = valid & seq.valid_residues(r)
    return reads.dropna(how="any", subset=["v_gene", "j_gene", *regions]).where(valid)


def known_genes(reads: DataFrame, genes: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Reads whose gene is listed, and the distinct genes that aren't."""
    listed = genes.select(column)
    return reads.join(F.broadcast(listed), column, "left_semi"), reads.select(column).distinct().join(F.broadcast(listed), column, "left_anti")


def derive(reads: DataFrame) -> DataFrame:
    """Genes from alleles, trimmed regions, the post sequence without the CDR3 before it, lengths, mutation rate, isotype group."""
    out = reads.withColumn("v_gene", vocab.mapped(seq.gene("v_segment"), vocab.V_RENAMES)).withColumn("j_gene", seq.gene("j_segment"))
    for r in REGIONS:
        out = out.withColumn(f"{r}_seq_aa_q_trim", seq.trim_sequence(f"{r}_seq_aa_q"))
    out = out.withColumn("post_seq_aa_q_trim", seq.without_prefix("post_seq_aa_q_trim", "cdr3_seq_aa_q_trim"))
    return (
        out.withColumn("cdr3_aa_sequence_trim_len", F.length("cdr3_seq_aa_q_trim").cast("long")).withColumn("v_mut", seq.mutation_rate("v_sequence"))
        .withColumn("isotype_supergroup", vocab.isotype_supergroup("extracted_isotype"))
    )


def fill_regions(reads: DataFrame, germlines: DataFrame, on: str = "v_call") -> tuple[DataFrame, DataFrame]:
    """Left join of germline regions by allele; alleles that miss, with their rows.  All missing raises."""
    joined = reads.join(F.broadcast(germlines.withColumn("_hit", F.lit(True))), on, "left")
    missing = joined.where(F.col("_hit").isNull()).groupBy(on).agg(F.count("*").alias("n"))
    if not reads.isEmpty() and joined.where("_hit").isEmpty():
        raise ValueError("no allele has germline regions")
    return joined.drop("_hit"), missing


def count_reads(reads: DataFrame, keys: list[str], order: list[str], keep: list[str], counts: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """One row for each key: the first in the order, with the number of reads (or the sum of their counts), and further sums {name: column}."""
    n = F.sum(counts) if counts else F.count("*")
    more = [F.sum(c).cast("long").alias(name) for name, c in (sums or {}).items()]
    first = F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_first")
    return reads.groupBy(*keys).agg(n.cast("long").alias("num_reads"), *more, first).select(*keys, "num_reads", *(sums or {}), *[F.col("_first")[c].alias(c) for c in keep])


def clone_counts(rows: DataFrame, isotypes: list[str]) -> DataFrame:
    """Distinct clones of each isotype for each specimen, 0 where there are none."""
    return rows.groupBy("specimen_label").agg(*[F.count_distinct(F.when(F.col("isotype_supergroup") == i, F.col("igh_or_tcrb_clone_id"))).alias(i) for i in isotypes])


def enough_clones(rows: DataFrame, required: dict[str, int]) -> DataFrame:
    """Rows of specimens with the required clones of every isotype."""
    counts = clone_counts(rows, list(required))
    good = F.lit(True)
    for isotype, n in required.items():
        good = good & (F.col(f"`{isotype}`") >= n)
    return rows.join(counts.where(good).select("specimen_label"), "specimen_label", "left_semi")


def enough_rows(rows: DataFrame, least: int) -> DataFrame:
    counts = rows.groupBy("specimen_label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(counts, "specimen_label", "left_semi")


def still_there() -> Column:
    """Whether a row isn't an unmutated IGHD-M one; with an unknown mutation rate it stays."""
    unmutated = (F.col("isotype_supergroup") == "IGHD-M") & (F.col("v_mut") < vocab.MUTATED_FROM)
    return ~F.coalesce(unmutated, F.lit(False))


def mutated_or_other(rows: DataFrame) -> DataFrame:
    """Without unmutated IGHD-M rows."""
    return rows.where(still_there())


def one_per_clone(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the most reads of each clone (ties by order), with the clone's reads and rows; one exchange and one sort."""
    clone = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(clone.orderBy(F.col("num_reads").desc(), *order)))
    counted = ranked.withColumn("total_clone_num_reads", F.sum("num_reads").over(clone)).withColumn("num_clone_members", F.count("*").over(clone))
    return counted.where("_rank = 1").drop("_rank")


def gated_specimens(rows: DataFrame, required: dict[str, int], least_rows: int) -> DataFrame:
    """Specimens that pass: enough clones of each isotype, and, without unmutated rows, enough rows and still each isotype.

    One aggregate by clone and one of its counts, in place of a join for each rule.
    """
    clone = rows.groupBy("specimen_label", "isotype_supergroup", "igh_or_tcrb_clone_id").agg(F.sum(still_there().cast("long")).alias("left"))
    own = lambda i: F.col("isotype_supergroup") == i
    known = F.col("igh_or_tcrb_clone_id").isNotNull()
    counts = clone.groupBy("specimen_label").agg(
        F.sum("left").alias("left"), *[F.sum((own(i) & known).cast("long")).alias(f"{i}|clones") for i in required],
        *[F.sum((own(i) & known & (F.col("left") > 0)).cast("long")).alias(f"{i}|left") for i in required],
    )
    passes = F.col("left") >= least_rows
    for i, n in required.items():
        passes = passes & (F.col(f"`{i}|clones`") >= n) & (F.col(f"`{i}|left`") > 0)
    return counts.where(passes).select("specimen_label")


def sample_clones(rows: DataFrame, required: dict[str, int], least_rows: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The whole gate: isotypes and CDR3 length, clone counts, unmutated rows out, row minimum, one row per clone, all isotypes still there."""
    kept = rows.where(F.col("isotype_supergroup").isin(*required) & (F.length("cdr3_seq_aa_q_trim") >= vocab.MIN_CDR3))
    passed = kept.join(gated_specimens(kept, required, least_rows), "specimen_label", "left_semi")
    return one_per_clone(mutated_or_other(passed), keys, order)


def row_ids(rows: DataFrame, file: str, order: list[str]) -> DataFrame:
    """One-based number of each row in its file, by an explicit order."""
    return rows.withColumn("row_id_in_participant_table", F.row_number().over(Window.partitionBy(file).orderBy(*order)).cast("long"))


def balanced_weights(rows: DataFrame, specimen: str, group: str) -> DataFrame:
    """Each group of a specimen weighs the same in sum: 1 / (k * n_group)."""
    per_group, per_specimen = Window.partitionBy(specimen, group), Window.partitionBy(specimen)
    return rows.withColumn("weight", 1 / (F.size(F.collect_set(group).over(per_specimen)) * F.count("*").over(per_group)))


def share(rows: DataFrame, value: str, within: list[str], name: str = "weight") -> DataFrame:
    """Value as a share of its group's total."""
    return rows.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*within)))


def real_families(rows: DataFrame, gene: str = "v_gene") -> DataFrame:
    """Without V genes of pseudogene families, whose names begin with VH; unknown genes stay."""
    return rows.where(~F.coalesce(F.col(gene).startswith("VH"), F.lit(False)))


def rows_per_specimen(kept: DataFrame, specimens: DataFrame) -> DataFrame:
    """Rows left of each specimen, 0 where none is."""
    counts = kept.groupBy("specimen_label").agg(F.count("*").alias("n"))
    return specimens.select("specimen_label").distinct().join(counts, "specimen_label", "left").select("specimen_label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
