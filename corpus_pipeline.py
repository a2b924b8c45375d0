"""Documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkoire.llm import common, decontam, linededup, neardup, packing, quality

Rows = DataFrame


def quality_stage(spark: SparkSession, docs: Rows, sf_dir: str) -> Rows:
    """Documents that the classifier takes for good ones.

    Null and empty texts have the prior's statistics and are scored like others;
    null ids match no label; repeated rows are each kept or not; without labels
    of both classes the share of label 1 decides for all.  An empty table stays
    empty, further columns are carried along.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: Rows, sf_dir: str) -> Rows:
    """Documents without the lines that earlier documents or lines hold; those that only had such lines go.

    Null texts and texts without words stay as they are.  Ties go by id, then by
    the text's digest, then by line; rows of one id and text lose the same lines.
    ``n_chars`` counts anew where lines went.  An empty table stays empty; of
    further columns only those of documents are returned.
    """
    out = linededup.line_dedup(docs)
    gone = (F.col("n_dropped") > 0) & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.col("n_dropped") > 0
    return out.where(~F.coalesce(gone, F.lit(False))).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def near_duplicate_stage(spark: SparkSession, docs: Rows, sf_dir: str) -> Rows:
    """One document of each group of near-duplicates, the one of the smallest id.

    Texts without words and null ids stay.  Of several rows of one id the least by
    its columns in JSON stays.  An empty table stays empty, further columns are
    carried along.
    """
    return neardup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: Rows, sf_dir: str) -> Rows:
    """Documents that hold no copy of a benchmark item, within the edit bound.

    Null and empty texts hold none; null items and items without words aren't
    looked for; repeated rows each stay or go.  Empty tables are allowed on either
    side, further columns are carried along whatever their names.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: Rows, sf_dir: str) -> Rows:
    """Token pieces and their places in sequences.

    Null and empty texts are one piece of the end token; null ids and repeated
    rows are packed like others; an empty table gives none.  Further columns
    aren't read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: A trained classifier, a tokenizer and a packing can't be put in SQL; tests/llm/test_stages.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> Rows:
    """All stages, each written before the next reads it."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
