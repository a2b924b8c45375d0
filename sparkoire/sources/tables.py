"""Readers of sequence tables in their several layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..checks import CheckFailed, require_all
from ..functions import sequence as seq
from ..operators.metadata import Target

# Spellings of a missing value, first those of vendors, then those that table readers take for one.
NULLS = (
    "no data", "unknown", "unresolved", "na", "null",
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan",
)
# Names of vendors' columns; of counts the first without nulls is used, of sequences the first that exists.
COUNT_COLUMNS = ("count (templates/reads)", "templates", "reads", "seq_reads")
NUCLEOTIDE_COLUMNS = ("cdr3_rearrangement", "rearrangement", "nucleotide")
AMINO_ACID_COLUMNS = ("amino_acid", "aminoAcid")
#: Names in further layouts, used where none of a vendor's is found.
OTHER_COUNT_COLUMNS = ("duplicate_count", "consensus_count", "count (templates)", "count")
OTHER_NUCLEOTIDE_COLUMNS = ("sequence", "vdj_nt", "cdr3nt")
OTHER_AMINO_ACID_COLUMNS = ("cdr3_aa", "junction_aa", "cdr3aa")


def database_table(spark: SparkSession, url: str, table: str, key: str, rows: int = 250_000) -> DataFrame:
    """A database's table, read by ranges of a numeric key, about so many rows each where keys are spread evenly; null keys too."""
    reader = spark.read.format("jdbc").option("url", url)
    low, high, n = reader.option("query", f'SELECT MIN("{key}") AS low, MAX("{key}") AS high, COUNT(*) AS n FROM {table}').load().first()
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if low is None or n <= rows:
        return reader.load()
    return reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=-(-n // rows)).load()


def participant_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Tab-separated, plain or compressed, one row per read; columns by name, t and f as booleans where ``productive`` is."""
    header = spark.read.option("sep", "\t").option("header", True).csv(path)
    wanted = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in header.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    out = header.select(*wanted)
    return out.withColumn("productive", F.when(F.col("productive") == "t", True).when(F.col("productive") == "f", False)) if "productive" in schema.names else out


def sample_file(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """A vendor or AIRR file, by its extension .csv or .tsv; spellings of missing values are null; a header alone gives no rows."""
    separator = "," if path.split(".gz")[0].split(".bz2")[0].endswith(".csv") else "\t"
    raw = spark.read.option("sep", separator).option("header", True).csv(path)
    clean = [F.when(~F.trim(F.col(f"`{c}`")).isin(*NULLS), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    return raw.select(*clean).withColumn("sample_name", F.lit(sample))


def first_present(df: DataFrame, names: tuple[str, ...]) -> str:
    for n in names:
        if n in df.columns:
            return n
    raise CheckFailed(f"none of {names} in {df.columns}")


def with_counts(df: DataFrame, expected: bool) -> DataFrame:
    """``num_reads`` from the first count column that has no nulls; 1 where no counts are expected, and then a vendor's count column raises."""
    present = [c for c in (*COUNT_COLUMNS, *OTHER_COUNT_COLUMNS) if c in df.columns]
    if not expected:
        if found := [c for c in present if c in COUNT_COLUMNS]:
            raise CheckFailed(f"unexpected count columns {found}")
        return df.withColumn("num_reads", F.lit(1).cast("long"))
    if not present:
        raise CheckFailed("no count column")
    nulls = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(present)]).first()
    usable = [c for i, c in enumerate(present) if not nulls[i]]
    if not usable:
        raise CheckFailed("every count column has nulls")
    return df.withColumn("num_reads", F.col(f"`{usable[0]}`").cast("double").cast("long"))


def vdjtools(df: DataFrame) -> DataFrame:
    """Count, frequency, CDR3 and gene columns in common names; alleles are the first, all rows productive."""
    renamed = df.withColumnsRenamed({"cdr3nt": "sequence", "cdr3aa": "cdr3_aa", "v": "v_call", "d": "d_call", "j": "j_call", "VEnd": "v_end", "JStart": "j_start"})
    calls = {c: F.when(F.col(c).isNotNull() & ~F.col(c).contains("*"), F.concat(F.col(c), F.lit("*01"))).otherwise(F.col(c)) for c in ("v_call", "d_call", "j_call")}
    return renamed.withColumns(calls).withColumn("productive", F.lit(True))


def common_columns(df: DataFrame, expected_counts: bool) -> DataFrame:
    """sample_name, sequence, amino acids and num_reads whatever the layout."""
    return with_counts(df, expected_counts).select(
        "sample_name", F.upper(F.col(f"`{first_present(df, NUCLEOTIDE_COLUMNS + OTHER_NUCLEOTIDE_COLUMNS)}`")).alias("sequence"),
        seq.trim_sequence(F.col(f"`{first_present(df, AMINO_ACID_COLUMNS + OTHER_AMINO_ACID_COLUMNS)}`")).alias("cdr3_aa"), "num_reads",
    )


def aligner_chunks(spark: SparkSession, pattern: str) -> DataFrame:
    """Parsed aligner outputs that a pattern of paths names, as one table; ids "name|row" are taken apart."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(pattern)
    parts = F.split("id", r"\|")
    return rows.withColumn("sample_name", parts[0]).withColumn("row_number", parts[1].cast("long"))


def join_aligned(rows: DataFrame, aligned: DataFrame) -> DataFrame:
    """Rows with their alignment by the explicit row number."""
    return rows.join(aligned, ["sample_name", "row_number"])


def sampled_table(spark: SparkSession, path: str, specimens: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of the listed specimens; the partition column prunes files; a specimen without rows raises."""
    rows = spark.read.parquet(path)
    out = require_all(rows, specimens.select("specimen_label").distinct(), "specimen_label")
    return out.select(*columns) if columns else out


def fold_table(rows: DataFrame, folds: DataFrame, fold_id: int, fold_label: str, key: str = "specimen_label") -> DataFrame:
    """Rows of a fold's label."""
    wanted = folds.where((F.col("fold_id") == fold_id) & (F.col("fold_label") == fold_label)).select(key).distinct()
    return rows.join(wanted, key, "left_semi")


def fold_embeddings(spark: SparkSession, path: str, folds: DataFrame, fold_id: int, fold_label: str, target: Target, columns: list[str] | None = None) -> DataFrame:
    """Stored embeddings of a fold's label that count for a target; cached, as models read them again and again."""
    rows = target.apply(fold_table(spark.read.parquet(path), folds, fold_id, fold_label))
    return (rows.select(*target.columns(columns)) if columns else rows).cache()


def manifest(files: DataFrame, whitelist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path) that the whitelist (file_name, ...) names, with its columns; listed names without a file."""
    named = files.withColumn("file_name", F.regexp_extract("path", r"([^/]+)$", 1))
    return named.join(whitelist, "file_name"), whitelist.join(named, "file_name", "left_anti")


def known_binders(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A reference of known binders in common names: genes from alleles, CDR3 without its end residues if it has them, distinct rows."""
    out = df.withColumnsRenamed({old: new for new, old in columns.items()}).withColumn("v_gene", seq.gene("v_gene")).withColumn("j_gene", seq.gene("j_gene"))
    cdr3 = seq.trim_sequence("cdr3")
    anchored = cdr3.startswith("C") & (cdr3.endswith("W") | cdr3.endswith("F"))
    out = out.withColumn("cdr3", F.when(anchored, seq.strip_ends(cdr3)).otherwise(cdr3))
    return out.where(seq.valid_residues("cdr3") & F.col("v_gene").isNotNull() & F.col("j_gene").isNotNull()).select(*columns).distinct()


def antibody_binders(df: DataFrame, target: str, binds: bool = True) -> DataFrame:
    """Human heavy chains of an antibody database that bind the target, or of which only the opposite is said: genes, CDR3 and chain, distinct.

    Null genes and the placeholder ND leave rows out; what follows a gene in parentheses goes.
    """
    positive, negative = ["Binds to", "Neutralising Vs"], ["Doesn't Bind to", "Not Neutralising Vs"]
    names = lambda columns: reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(f"`{c}`"), F.lit(""))).contains(target.lower()) for c in columns])
    said = names(positive) & ~names(negative[:1]) if binds else names(negative[:1]) & ~names(positive)
    human = F.col("`Heavy V Gene`").contains("(Human)") & F.col("`Heavy J Gene`").isNotNull()
    kept = df.where(said & human)
    for c in ("Heavy J Gene", "CDRH3", "VHorVHH"):
        kept = kept.where(F.col(f"`{c}`") != "ND")
    bare = lambda c: F.trim(F.substring_index(F.col(f"`{c}`"), "(", 1))
    return kept.select(bare("Heavy V Gene").alias("v_gene"), bare("Heavy J Gene").alias("j_gene"), seq.trim_sequence("CDRH3").alias("cdr3"), F.col("VHorVHH").alias("chain")).distinct()


def assay_binders(df: DataFrame, column: str = "TCR BioIdentity", antigen: str = "Amino Acids") -> DataFrame:
    """Binders of a T-cell assay, cdr3+V+J in one column: genes in the common spelling, CDR3 without its end residues, unresolved genes out, distinct."""
    parts = split_identity(df, column)
    common = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^TCR", "TR"), "([VJ])0", "$1"), "-0", "-")
    out = parts.select(common("v_gene").alias("v_gene"), common("j_gene").alias("j_gene"), seq.strip_ends(seq.trim_sequence("cdr3")).alias("cdr3"), F.col(f"`{antigen}`").alias("antigen"))
    known = ~F.col("v_gene").isin("unresolved", "X") & ~F.col("j_gene").isin("unresolved", "X") & seq.valid_residues("cdr3")
    return out.where(known).distinct()


def split_identity(df: DataFrame, column: str, separator: str = r"\+") -> DataFrame:
    """cdr3+V+J as three columns."""
    parts = F.split(column, separator)
    return df.withColumns({"cdr3": parts.getItem(0), "v_gene": parts.getItem(1), "j_gene": parts.getItem(2)})
