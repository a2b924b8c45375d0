"""Row numbering and column checks; written tables come from the library's storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Just the two columns, so that others can't clash."""
    need(df, id_col, text_col)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def numbered(scratch: Scratch, df: DataFrame, order: list[str], name: str = "rn", partitions: int | None = None) -> tuple[DataFrame, int]:
    """Rows numbered 0..n-1 in the total order of ``order``, and n.

    One range exchange of the narrow frame; the sorted pieces are written, then
    one count per piece (a row per partition) gives each piece its first number.
    """
    spark = scratch.spark
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    pieces = scratch.cut(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .select("*", F.shiftright("_at", 33).alias("_piece"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"))
        .drop("_at")
    )
    counts = {r[0]: r[1] for r in pieces.groupBy("_piece").count().collect()}  # a row per partition
    starts, total = [], 0
    for piece in sorted(counts):
        starts.append((piece, total))
        total += counts[piece]
    first = spark.createDataFrame(starts or [(0, 0)], "_piece long, _start long")
    out = pieces.join(F.broadcast(first), "_piece").withColumn(name, F.col("_start") + F.col("_in"))
    return out.drop("_piece", "_in", "_start"), total


#: Rows of a few bytes that may be broadcast.
SENT_ROWS = 500_000


def sent_if_small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """The narrow frame, marked for broadcast if it's counted to have few rows; else a join shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
