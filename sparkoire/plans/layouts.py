"""Queries: readers and writers of every layout, each written first and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..operators import folds, models
from ..operators.metadata import Target
from ..sources import sequences, sinks, tables
from ..storage import Scratch, mounted
from .catalogue import query
from .roles import ROLE_SQL, rows, sql
from .tables import _DNA, dna, rounded, table


def folder(spark):
    return Scratch(spark, "io").root


def write_csv(df, path, separator="\t", **options):
    df.write.option("sep", separator).option("header", True).options(**options).csv(path)
    return path


PARTICIPANT_PART = StructType([StructField("participant_label", StringType()), StructField("v_segment", StringType()), StructField("v_score", DoubleType()), StructField("productive", StringType()), StructField("spam_score", DoubleType())])


@query("SELECT p_brand AS participant_label, p_type AS v_segment, p_retailprice AS v_score, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS productive, CAST(NULL AS DOUBLE) AS spam_score FROM part")
def participant_tables(spark, sf):
    flag = F.when(F.col("p_size") % 3 == 0, "t").when(F.col("p_size") % 3 == 1, "f")
    p = table(spark, sf, "part").select("p_size", F.col("p_type").alias("v_segment"), F.col("p_brand").alias("participant_label"), flag.alias("productive"), F.col("p_retailprice").alias("v_score"))
    return tables.participant_table(spark, write_csv(p, folder(spark), compression="bzip2"), PARTICIPANT_PART)


# Vendor files: four layouts, one of a header alone.
_MISSING = "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN NULL ELSE 'CAS' || p_size % 7 END"


@query(f"SELECT sample_name, sequence, nullif(upper(trim(translate(replace(replace(replace(replace(replace(replace(replace(aa, '0', 'A'), '2', 'C'), '3', 'D'), '4', 'E'), '5', 'F'), '6', 'G'), '1', 'A'), '.- *', ''))), '') AS cdr3_aa, num_reads FROM (SELECT 'v2' AS sample_name, {_DNA} AS sequence, {_MISSING} AS aa, CAST(p_size AS BIGINT) AS num_reads FROM part UNION ALL SELECT 'code', {_DNA}, {_MISSING}, p_partkey FROM part UNION ALL SELECT 'emerson', substr({_DNA}, 1, 9), {_MISSING}, CAST(p_size + 1 AS BIGINT) FROM part UNION ALL SELECT 'airr', {_DNA}, {_MISSING}, 1 FROM part)")
def vendor_files(spark, sf):
    p = table(spark, sf, "part")
    missing = F.when(F.col("p_size") % 7 == 0, "unknown").when(F.col("p_size") % 7 == 1, "n/a").otherwise(F.concat(F.lit("cas"), F.translate((F.col("p_size") % 7).cast("string"), "0123456", "AACDEFG")))
    size, bases = F.col("p_size"), F.lower(dna())
    files = {
        ("v2", ",", "csv"): p.select(bases.alias("nucleotide"), missing.alias("aminoAcid"), size.alias("count (templates/reads)"), F.lit(5).alias("reads")),
        ("code", "\t", "tsv"): p.select(bases.alias("rearrangement"), missing.alias("amino_acid"), F.when(size % 2 == 0, "na").otherwise("3").alias("templates"), F.col("p_partkey").alias("reads"), F.lit(9).alias("seq_reads")),
        ("emerson", "\t", "tsv"): p.select(F.substring(bases, 1, 9).alias("cdr3_rearrangement"), bases.alias("rearrangement"), missing.alias("amino_acid"), (size + 1).alias("seq_reads")),
        ("airr", "\t", "tsv"): p.select(bases.alias("sequence"), missing.alias("cdr3_aa")),
        ("empty", "\t", "tsv"): p.where("false").select(bases.alias("rearrangement"), missing.alias("amino_acid"), size.alias("reads")),
    }
    out = []
    for (name, separator, extension), df in files.items():
        path = write_csv(df.coalesce(1), f"{folder(spark)}.{extension}", separator)
        out.append(tables.common_columns(tables.sample_file(spark, path, name), name != "airr"))
    return folds.union_all(out)


@query("SELECT 's' AS sample_name, substr(" + _DNA + ", 1, 12) AS sequence, 'TRBV' || p_size || '*01' AS v_call, CASE WHEN p_size % 2 = 0 THEN 'TRBD1*02' END AS d_call, true AS productive, CAST(p_size AS BIGINT) AS num_reads FROM part")
def vdjtools_files(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").alias("count"), F.substring(dna(), 1, 12).alias("cdr3nt"), F.lit("CASS").alias("cdr3aa"), F.concat(F.lit("TRBV"), F.col("p_size").cast("string")).alias("v"), F.when(F.col("p_size") % 2 == 0, "TRBD1*02").otherwise(".").alias("d"), F.lit("TRBJ1-1").alias("j"))
    read = tables.sample_file(spark, write_csv(p.withColumn("d", F.nullif("d", F.lit("."))), folder(spark) + ".tsv"), "s")
    return tables.with_counts(tables.vdjtools(read), True).select("sample_name", "sequence", "v_call", "d_call", "productive", "num_reads")


@query("SELECT 's' || p_partkey % 3 AS sample_name, p_partkey AS row_number, p_brand, 'V' || p_size AS v_call FROM part")
def aligner_tables(spark, sf):
    p, root = table(spark, sf, "part"), folder(spark)
    sample = F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string"))
    for i in range(3):
        chunk = p.where(F.col("p_partkey") % 3 == i).select(F.concat_ws("|", sample, F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("V"), F.col("p_size").cast("string")).alias("v_call"))
        write_csv(chunk, f"{root}/chunk{i}.parsed.tsv")
    aligned = tables.aligner_chunks(spark, f"{root}/*.parsed.tsv")
    own = p.select(sample.alias("sample_name"), F.col("p_partkey").alias("row_number"), "p_brand")
    return tables.join_aligned(own, aligned).select("sample_name", "row_number", "p_brand", "v_call")


_FOLD = "SELECT DISTINCT specimen_label, participant_label, disease FROM r"


def _embedded(spark, sf):
    df = rows(spark, sf, ["specimen_label", "participant_label", "disease"]).distinct()
    return df.select("specimen_label", F.when(F.col("disease") != "BUILDING", F.col("disease")).alias("disease"), F.length("specimen_label").alias("size"), (F.length("participant_label") % 2).alias("fold_id"), F.lit("test").alias("fold_label"))


@query(sql(f"SELECT specimen_label, disease, CAST(length(specimen_label) AS INTEGER) AS size FROM ({_FOLD}) WHERE length(participant_label) % 2 = 1 AND disease IN ('AUTOMOBILE', 'FURNITURE')"))
def fold_embeddings(spark, sf):
    e, path = _embedded(spark, sf), folder(spark)
    sinks.embeddings(e.drop("fold_id", "fold_label").withColumns({"fold_id": F.col("size") % 2, "fold_label": F.lit("all")}), path)
    target = Target("disease", {"disease": ("AUTOMOBILE", "FURNITURE", "BUILDING")})
    return tables.fold_embeddings(spark, path, e.select("specimen_label", "fold_id", "fold_label"), 1, "test", target, ["specimen_label", "size"]).select("specimen_label", "disease", "size")


@query(sql(f"SELECT specimen_label, disease FROM ({_FOLD}) WHERE length(participant_label) % 2 = 0"))
def fold_rows(spark, sf):
    df = rows(spark, sf, ["specimen_label", "participant_label", "disease"]).distinct()
    splits = df.select("specimen_label", (F.length("participant_label") % 2).alias("fold_id"), F.lit("test").alias("fold_label"))
    return tables.fold_table(df, splits, 0, "test").select("specimen_label", "disease")


@query(f"SELECT 'r' || p_partkey AS name, {_DNA} AS sequence, repeat('@', p_size) || '+' AS quality FROM part")
def fastq_roundtrip(spark, sf):
    record = F.concat(F.lit("@r"), F.col("p_partkey").cast("string"), F.lit("\n"), F.lower(dna()), F.lit("\n+\n"), F.repeat(F.lit("@"), F.col("p_size")), F.lit("+"))
    path = folder(spark)
    table(spark, sf, "part").select(record.alias("value")).write.option("compression", "gzip").text(path)
    return sequences.fastq(spark, path).select("name", "sequence", "quality")


@query("SELECT 'q' || p_partkey AS name, 'V' || p_size AS v_call, round((9 * (80 + p_size % 20) + 6 * 50.0) / 15, 6) AS identity, substr(s, 1, 9) AS fr1, substr(s, 10, 6) AS cdr1 FROM (SELECT *, " + _DNA + " AS s FROM part)")
def protein_reports(spark, sf):
    p, path = table(spark, sf, "part"), folder(spark)
    text = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    key, v = F.col("p_partkey").cast("string"), F.concat(F.lit("V"), F.col("p_size").cast("string"))
    block = text("Query= q", key, "\n\n", v, "   55.1   1e-20\n\nFR1-IMGT  1  9  9  7  2  0  ", (80 + F.col("p_size") % 20).cast("string"), "\nCDR1-IMGT  10  15  6  3  3  0  50\nFR2-IMGT  N/A  N/A  N/A  N/A  N/A  N/A  N/A\n")
    p.select(block.alias("value")).write.text(path)
    queries = p.select(F.concat(F.lit("q"), key).alias("name"), dna().alias("sequence"))
    return rounded(sequences.protein_report(spark, path, queries), "identity").select("name", "v_call", "identity", "fr1", "cdr1")


@query("SELECT 'q' || p_partkey AS name, 'V' || p_size AS v_call, CASE WHEN p_size % 2 = 0 THEN 'D1' END AS d_call, 'J2' AS j_call, p_size % 3 = 0 AS productive, 'ACG' || p_size % 4 || 'GT' AS junction FROM part WHERE p_partkey % 5 <> 0")
def nucleotide_reports(spark, sf):
    p, path = table(spark, sf, "part"), folder(spark)
    text = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    d = F.when(size % 2 == 0, "D1,D2").otherwise("N/A")
    summary = text("V", size.cast("string"), ",V99\t", d, "\tJ2\tVH\tNo\tYes\t", F.when(size % 3 == 0, "Yes").otherwise("No"), "\t+\n")
    hit = text("Query= q", key, "\n\nV-(D)-J rearrangement summary for query sequence\n", summary, "\nV-(D)-J junction details based on top germline gene matches\nACG\t", (size % 4).cast("string"), "\tN/A\t\tGT\t\n")
    p.select(F.when(F.col("p_partkey") % 5 == 0, text("Query= q", key, "\n\n***** No hits found *****\n")).otherwise(hit).alias("value")).write.text(path)
    return sequences.nucleotide_report(spark, path, "BCR").select("name", "v_call", "d_call", "j_call", "productive", "junction")


@query("SELECT p_brand AS cluster, m AS member, n = 0 AS is_representative FROM (SELECT p_brand, unnest([p_brand, 'm' || s, 'k' || s]) AS m, unnest([0, 1, 2]) AS n FROM (SELECT p_brand, max(p_size) AS s FROM part GROUP BY 1))")
def member_lists(spark, sf):
    path = folder(spark)
    s = F.max("p_size").cast("string")
    lines = table(spark, sf, "part").groupBy("p_brand").agg(s.alias("s"))
    lines.select(F.concat(F.col("p_brand"), F.lit("\tm"), F.col("s"), F.lit(",k"), F.col("s")).alias("value")).write.text(path)
    return sequences.member_lists(spark, path)


@query("SELECT CAST(n AS BIGINT) AS cluster, 'm' || n || '_' || k AS member, CAST(100 + k AS INTEGER) AS length, CASE WHEN k > 0 THEN 95.5::DOUBLE END AS identity, k = 0 AS is_representative FROM (SELECT DISTINCT p_size AS n FROM part), (SELECT unnest([0, 1]) AS k)")
def clusterer_listings(spark, sf):
    path, n = folder(spark), F.col("p_size").cast("string")
    block = F.concat(F.lit(">Cluster "), n, F.lit("\n0\t100aa, >m"), n, F.lit("_0... *\n1\t101aa, >m"), n, F.lit("_1... at 95.50%"))
    table(spark, sf, "part").select("p_size").distinct().select(block.alias("value")).write.text(path)
    return sequences.cdhit_clusters(spark, path).drop("file")


@query("SELECT * FROM (VALUES ('a.tsv', 'S1', true), ('b.tsv', 'S2', true), ('c.tsv', 'S3', false)) t(file_name, specimen, found)")
def manifest_files(spark, sf):
    root = folder(spark)
    files = spark.createDataFrame([(f"{root}/{n}",) for n in ("a.tsv", "b.tsv", "other.tsv")], "path string")
    listed = spark.createDataFrame([("a.tsv", "S1"), ("b.tsv", "S2"), ("c.tsv", "S3")], "file_name string, specimen string")
    found, missing = tables.manifest(files, listed)
    return found.select("file_name", "specimen", F.lit(True).alias("found")).union(missing.select("file_name", "specimen", F.lit(False)))


_VHH = "CASE WHEN p_size % 11 = 0 THEN 'ND' ELSE 'VH' END"


@query(f"SELECT DISTINCT 'IGHV' || p_size % 9 AS v_gene, 'IGHJ' || p_size % 6 AS j_gene, 'CAR' || translate(CAST(p_size % 10 AS VARCHAR), '0123456789', 'ACDEFGHIKL') AS cdr3, {_VHH} AS chain FROM part WHERE (p_size % 2 = 0 OR p_size % 3 = 0) AND p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_size % 13 <> 0")
def antibody_binders(spark, sf):
    size = F.col("p_size")
    p = table(spark, sf, "part").select(
        F.when(size % 2 == 0, "SARS-CoV2_WT;MERS").alias("Binds to"), F.when(size % 3 == 0, "sars-cov2").alias("Neutralising Vs"), F.when(size % 5 == 0, "SARS-CoV2").alias("Doesn't Bind to"), F.lit("").alias("Not Neutralising Vs"),
        F.concat(F.lit("IGHV"), (size % 9).cast("string"), F.when(size % 7 == 0, " (Mouse)").otherwise(" (Human)")).alias("Heavy V Gene"),
        F.when(size % 13 == 0, "ND").otherwise(F.concat(F.lit("IGHJ"), (size % 6).cast("string"), F.lit(" (Human)"))).alias("Heavy J Gene"),
        F.concat(F.lit("car"), F.translate((size % 10).cast("string"), "0123456789", "ACDEFGHIKL")).alias("CDRH3"), F.when(size % 11 == 0, "ND").otherwise("VH").alias("VHorVHH"),
    )
    return tables.antibody_binders(p, "SARS-CoV2")


@query("SELECT DISTINCT 'TRBV' || p_size % 9 + 1 || '-1' AS v_gene, 'TRBJ2-' || p_size % 6 AS j_gene, 'AS' || translate(CAST(p_size % 10 AS VARCHAR), '0123456789', 'ACDEFGHIKL') AS cdr3, p_brand AS antigen FROM part WHERE p_size % 4 <> 0")
def assay_binders(spark, sf):
    size = F.col("p_size")
    cdr3 = F.concat(F.lit("CAS"), F.translate((size % 10).cast("string"), "0123456789", "ACDEFGHIKL"), F.lit("F"))
    v = F.when(size % 4 == 0, "unresolved").otherwise(F.concat(F.lit("TCRBV0"), (size % 9 + 1).cast("string"), F.lit("-01")))
    p = table(spark, sf, "part").select(F.concat_ws("+", cdr3, v, F.concat(F.lit("TCRBJ02-0"), (size % 6).cast("string"))).alias("TCR BioIdentity"), F.col("p_brand").alias("Amino Acids"))
    return tables.assay_binders(p)


@query("SELECT DISTINCT 'IGHV' || p_size AS v_gene, 'IGHJ1' AS j_gene, CASE WHEN p_size % 2 = 0 THEN 'ARD' ELSE 'CARDY' END AS cdr3 FROM part WHERE p_size % 3 <> 0")
def known_binders(spark, sf):
    size = F.col("p_size")
    p = table(spark, sf, "part").select(F.concat(F.lit("IGHV"), size.cast("string"), F.lit("*01")).alias("V"), F.lit("IGHJ1*02").alias("J"), F.when(size % 3 == 0, "CA*1W").when(size % 2 == 0, "CARDW").otherwise("CARDY").alias("junction"))
    return tables.known_binders(p, {"v_gene": "V", "j_gene": "J", "cdr3": "junction"})


# Writers.
@query(f"WITH r AS ({ROLE_SQL}) SELECT DISTINCT participant_label, specimen_label, v_gene FROM r")
def participant_files(spark, sf):
    path = folder(spark)
    sinks.by_participant(rows(spark, sf, ["participant_label", "specimen_label", "v_gene"]).distinct(), path)
    return spark.read.option("sep", "\t").option("header", True).csv(path).select(F.col("participant_label").cast("string").alias("participant_label"), "specimen_label", "v_gene")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS at, round((e[i]::DOUBLE - m) / s, 5) AS x FROM (SELECT vec_id, embedding AS e FROM embeddings), generate_series(1, 4) g(i) JOIN (SELECT d, avg(x) AS m, stddev_samp(x) AS s FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d, vec_id FROM embeddings WHERE vec_id % 2 = 0) GROUP BY 1) t ON t.d = g.i")
def stored_transforms(spark, sf):
    from pyspark.ml import PipelineModel

    e, path = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("embedding")), folder(spark)
    sinks.transforms(models.standardisation(e.where("vec_id % 2 = 0"), "embedding"), path)
    out = models.standardised(PipelineModel.load(path), e, "embedding")
    return rounded(out.select("vec_id", F.posexplode("embedding").alias("at", "x")), "x", digits=5)


@query("SELECT p_partkey, p_brand, p_retailprice FROM part")
def database_load(spark, sf):
    place = f"{mounted(folder(spark))}/loaded"
    sinks.embedded(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), place, "loaded", createTableColumnTypes="p_brand VARCHAR(64)")
    return tables.database_table(spark, sinks.packed_database(spark, place), "loaded", "p_partkey").toDF("p_partkey", "p_brand", "p_retailprice")
