"""Readers of sequence files, cluster lists and aligner reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as seq


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, sequence); records may span lines.  Files split at record starts, so a large one is read in parallel."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^>", "").alias("r"))
    head = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.substring("r", F.length(head) + 1, F.length("r")), r"\s", "")
    return records.where(F.trim("r") != "").select("file", head.alias("name"), F.upper(body).alias("sequence"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, sequence, quality) of four-line records whose third line is a plus sign alone.

    Files split between that line and the quality: a piece holds one record's
    quality and the next one's name and sequence.  Pieces follow each other within
    a block of the file; the first of each block is looked up by the block before.
    """
    pieces = spark.read.option("lineSep", "\n+\n").text(path).select(
        F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.split(F.rtrim(F.regexp_replace("value", "\r", "")), "\n").alias("lines"),
    )
    own = Window.partitionBy("file", "block").orderBy("at")
    heads = pieces.groupBy("file", "block").agg(F.min_by(F.get("lines", F.lit(0)), "at").alias("head"))
    after = heads.select("file", "block", F.lead("head").over(Window.partitionBy("file").orderBy("block")).alias("head"))  # a row for each block of a file
    rows = pieces.withColumn("next", F.lead(F.get("lines", F.lit(0))).over(own)).join(after, ["file", "block"])
    name, sequence = F.element_at("lines", -2), F.element_at("lines", -1)
    records = rows.where((F.size("lines") >= 2) & F.coalesce("next", "head").isNotNull())
    return records.select("file", F.substring(name, F.lit(2), F.length(name)).alias("name"), F.upper(sequence).alias("sequence"), F.coalesce("next", "head").alias("quality"))


def member_lists(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, member, is_representative) of lines of members, tabs or commas between; the first is the representative."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "[\t,]").alias("m"))
    return lines.select(F.get("m", F.lit(0)).alias("cluster"), F.posexplode("m").alias("at", "member")).select("cluster", "member", (F.col("at") == 0).alias("is_representative"))


def cdhit_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(file, cluster, member, length, identity, is_representative) of a greedy clusterer's listing."""
    text = spark.read.option("lineSep", "\n>Cluster ").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^>Cluster ", "").alias("value"))
    lines = text.select("file", F.regexp_extract("value", r"^(\d+)", 1).cast("long").alias("cluster"), F.explode(F.split("value", "\n")).alias("line")).where(F.col("line").contains(">"))
    return lines.select(
        "file", "cluster", F.regexp_extract("line", r">(.+?)\.\.\.", 1).alias("member"), F.regexp_extract("line", r"(\d+)(?:aa|nt)", 1).try_cast("int").alias("length"),
        F.regexp_extract("line", r"([\d.]+)%", 1).try_cast("double").alias("identity"), F.rtrim("line").endswith("*").alias("is_representative"),
    )


PROTEIN_REGIONS = ("fr1", "cdr1", "fr2", "cdr2", "fr3")
_SUMMARY = re.compile(r"^(FR[123]|CDR[12]|FWR[123])(?:-IMGT)?\s+(\d+|N/A)\s+(\d+|N/A)\s+(\d+|N/A)\s+\S+\s+\S+\s+\S+\s+([\d.]+|N/A)", re.M)


def protein_block(block: str) -> tuple | None:
    """(name, v, [(region, begin, end, length, identity)]) of one query of a protein aligner's report; None without a hit."""
    name = block.split("\n", 1)[0].strip()
    hit = re.search(r"^(\S+)\s+[\d.]+\s+[\d.e+-]+\s*$", block, re.M) or re.search(r"^>\s*(\S+)", block, re.M)
    regions = []
    for label, begin, end, length, identity in _SUMMARY.findall(block):
        if "N/A" not in (begin, end, length, identity):
            regions.append((label.lower().replace("fwr", "fr"), int(begin), int(end), int(length), float(identity)))
    return (name, hit[1] if hit else None, regions) if hit or regions else None


def blocks(text: str) -> Iterator[str]:
    """Stretches of a report from each "Query=" to the next one or to the database's footer."""
    for part in text.split("Query=")[1:]:
        yield re.split(r"\n\s*(?:Database:|Total queries)", part)[0].strip()


def protein_report(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(name, v_call, identity, fr1 .. fr3) : identity weighted by length, regions cut from the query (name, sequence) by begin and end."""

    def run(batches):
        for b in batches:
            found = [x for text in b.column("value").to_pylist() for x in map(protein_block, blocks(text)) if x]
            kind = pa.list_(pa.struct([("region", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("length", pa.int32()), ("identity", pa.float64())]))
            regions = [[dict(zip(("region", "begin", "end", "length", "identity"), r, strict=True)) for r in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array(regions, kind)], ["name", "v_call", "regions"])

    schema = "name string, v_call string, regions array<struct<region:string,begin:int,end:int,length:int,identity:double>>"
    parsed = spark.read.text(path, wholetext=True).mapInArrow(run, schema)
    total = F.aggregate("regions", F.lit(0.0), lambda s, r: s + r["length"] * r["identity"])
    length = F.aggregate("regions", F.lit(0.0), lambda s, r: s + r["length"])

    def cut(region):
        one = F.get(F.filter("regions", lambda r: r["region"] == region), F.lit(0))
        return F.substring("sequence", one["begin"], one["end"] - one["begin"] + 1).alias(region)

    return parsed.join(queries, "name").select("name", "v_call", (total / F.nullif(length, F.lit(0.0))).alias("identity"), *map(cut, PROTEIN_REGIONS))


CHAINS = {"BCR": "VH", "TCR": "VB"}
MOTIFS = {"BCR": ("WG.G",), "TCR": ("FG.G",)}
_FLAGS = {"Yes": True, "No": False, "N/A": None}


def nucleotide_block(block: str, chain: str) -> dict | None:
    """Calls, flags and the junction of one query; None for no hits or another chain.

    The first listed call of a gene wins.  Bases of a junction in parentheses
    overlap: they count as the gene's, and the junction is empty.
    """
    if "No hits found" in block:
        return None
    lines = block.split("\n")
    out = {"name": lines[0].strip()}
    for k, line in enumerate(lines):
        if "rearrangement summary" in line and k + 1 < len(lines):
            fields = lines[k + 1].split("\t")
            fields = [None, *fields] if len(fields) == 7 else fields
            calls = [None if f in (None, "N/A") else f.split(",")[0] for f in fields[:3]]
            out |= {"v_call": calls[0], "d_call": calls[1], "j_call": calls[2], "chain": fields[3], "stop_codon": _FLAGS.get(fields[4]), "in_frame": _FLAGS.get(fields[5].rstrip("*")), "productive": _FLAGS.get(fields[6])}
            if len(lines[k + 1].split("\t")) == 7:
                out |= {"v_call": calls[1], "d_call": None}
        elif "junction details" in line and k + 1 < len(lines):
            parts = lines[k + 1].rstrip("\t").split("\t")
            clean = [None if p in ("", "N/A") else p for p in parts]
            overlap = any(p and p.startswith("(") for p in clean)
            out |= {"junction": "".join("" if not p or p.startswith("(") else p for p in clean), "overlap": overlap}
        elif (m := re.match(r"^V\s+[\d.]+%\s+\S+\s+(\S+)\s+(\d+)\s+\S*\s*(\d+)", line)) and "v_begin" not in out:
            out |= {"v_begin": int(m[2]), "frame": (int(m[2]) - 1) % 3}
    return out if out.get("chain") == chain else None


NUCLEOTIDE_SCHEMA = "name string, v_call string, d_call string, j_call string, chain string, stop_codon boolean, in_frame boolean, productive boolean, junction string, overlap boolean, v_begin int, frame int"


def nucleotide_report(spark: SparkSession, path: str, locus: str) -> DataFrame:
    """A row for each query of a nucleotide aligner's text report that has hits of the locus; others give none."""
    columns = [c.split()[0] for c in NUCLEOTIDE_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in NUCLEOTIDE_SCHEMA.split(", ")])

    def run(batches):
        for b in batches:
            rows = [x for text in b.column("value").to_pylist() for x in (nucleotide_block(k, CHAINS[locus]) for k in blocks(text)) if x]
            yield pa.RecordBatch.from_pylist([{c: x.get(c) for c in columns} for x in rows], fields)

    return spark.read.text(path, wholetext=True).mapInArrow(run, NUCLEOTIDE_SCHEMA)


def split_at_motif(df: DataFrame, after: str, locus: str) -> DataFrame:
    """``cdr3`` up to the motif behind the last framework residue, ``post`` from it on; without a motif all is ``post``."""
    at = seq.rightmost_motif(after, MOTIFS[locus])
    found = at >= 0
    return df.withColumn("cdr3", F.when(found, F.substring(after, F.lit(1), at))).withColumn("post", F.when(found, F.substring(after, at + 1, F.length(after))).otherwise(F.col(after)))
