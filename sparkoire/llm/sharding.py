"""Reproducible shuffle and shards from a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Multiplier, offset and modulus of the round function; below 2**31, so no product leaves 63 bits.
ROUND_A, ROUND_B, ROUND_P = 1_103_515_245, 12_345, 2_147_483_647
ROUNDS = 6


def half_bits(n: int) -> int:
    """Bits of each half: the smallest square domain of a power of two that holds n numbers."""
    bits = 1
    while 1 << (2 * bits) < n:
        bits += 1
    return bits


def mix(half: np.ndarray, round_no: int, seed: int, bits: int) -> np.ndarray:
    """Keyed function of one half: affine modulo a prime, squared, low bits of the upper part."""
    x = (half % ROUND_P * ROUND_A + ROUND_B * (round_no + 1) + seed) % ROUND_P
    x = x * x % ROUND_P
    return (x >> 5) & ((1 << bits) - 1)


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A bijection of 0..n-1: Feistel rounds over the square domain, walked on until inside.

    Empty input gives empty output; n = 1 gives 0.  Each walk ends because a
    permutation's cycle through a number below n returns to one.
    """
    bits = half_bits(n)
    mask = (1 << bits) - 1
    out = np.array(numbers, dtype=np.int64)
    todo = np.arange(out.size)
    while todo.size:
        left, right = out[todo] >> bits, out[todo] & mask
        for k in range(ROUNDS):
            left, right = right, left ^ mix(right, k, seed, bits)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= n]
    return out


def shard(df: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows to shards by law ``rows``: counts are at most one apart.

    Rows are numbered in the order (id, crc32, size), permuted by ``permute`` and
    dealt round robin: shard = place % shards, slot = place // shards.  Both can
    be computed from a row's number alone, and undone.

    Null ids sort first and are dealt like others; a null text has size 8 and the
    crc32 of no bytes (0), an empty text likewise.  Repeated rows tie in the
    order, are alike in every column and take adjacent numbers.  An empty table
    gives an empty result.  Further columns of the input aren't read.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = common.ids_and_text(df, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    numbered, n = common.numbered(common.Scratch(spark, "shard"), narrow, ["doc_id", "text_crc32", "size"])

    def deal(batches):
        for b in batches:
            place = permute(b.column("rn").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(place % shards, pa.int32()), pa.array(place // shards, pa.int64())],
                ["doc_id", "size", "text_crc32", "shard", "slot"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    dealt = numbered.mapInArrow(deal, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.documents(spark, sf_dir))


