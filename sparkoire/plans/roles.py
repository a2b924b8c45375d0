"""The star schema's tables in the roles of sequence tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab

#: Orders rows; the first two alone aren't unique.
TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
TIES_SQL = ", ".join(TIES)
CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ISOTYPES = ["IGHG", "IGHA", "IGHD-M"]
V_GENES = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]
HEX, RESIDUES = "0123456789abcdef", "ACDEFGHIKLMNPQRS"


def _cdr3() -> Column:
    base = F.substring(F.translate(F.md5((F.col("l_partkey") % 97).cast("string")), HEX, RESIDUES), F.lit(1), 8 + F.col("p_size") % 5)
    at = (F.col("l_partkey") % 8).cast("int")
    changed = F.concat(F.substring(base, F.lit(1), at), F.lit("W"), F.substring(base, at + 2, F.length(base)))
    return F.when(F.col("l_partkey") % 3 == 0, changed).otherwise(base)


COLUMNS = {
    "participant_label": ("customer", lambda: F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment")),
    "specimen_label": ("customer", lambda: F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment", F.concat(F.lit("T"), (F.year("o_orderdate") % 2).cast("string")))),
    "disease": ("customer", lambda: F.col("c_mktsegment")),
    "study_name": ("region", lambda: F.col("r_name")),
    "order_date": ("orders", lambda: F.to_date("o_orderdate")),
    "v_gene": ("part", lambda: F.col("p_brand")),
    "j_gene": ("part", lambda: F.col("p_type")),
    "isotype_supergroup": ("lineitem", lambda: vocab.mapped("l_returnflag", {"A": "IGHA", "N": "IGHD-M", "R": "IGHG"})),
    "igh_or_tcrb_clone_id": ("lineitem", lambda: F.col("l_partkey")),
    "num_reads": ("lineitem", lambda: F.col("l_quantity").cast("long")),
    "v_mut": ("lineitem", lambda: F.col("l_discount")),
    "cdr3_seq_aa_q_trim": ("part", _cdr3),
} | {t: ("lineitem", lambda t=t: F.col(t)) for t in TIES}


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A table of fewer splits than there are cores is dealt out by hash; a large one is read as it lies."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *keys) if df.rdd.getNumPartitions() < n else df


def rows(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """The named columns of the role table; only tables that they need are read and joined."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {COLUMNS[c][0] for c in columns}
    own = {"l_orderkey", "l_partkey"} | {t for t in TIES if t in columns}
    own |= {c for name, kept in (("num_reads", "l_quantity"), ("v_mut", "l_discount"), ("isotype_supergroup", "l_returnflag")) if name in columns for c in (kept,)}
    df = dealt(table("lineitem").select(*sorted(own)), "l_orderkey", "l_partkey")
    if needs & {"orders", "customer", "region"}:
        df = df.join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if needs & {"customer", "region"}:
        df = df.join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    if "region" in needs:
        df = df.join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    if "part" in needs:
        df = df.join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return df.select(*[COLUMNS[c][1]().alias(c) for c in columns])


_BASE = f"substr(translate(md5(CAST(l_partkey % 97 AS VARCHAR)), '{HEX}', '{RESIDUES}'), 1, 8 + p_size % 5)"
ROLE_SQL = f"""
SELECT {TIES_SQL}, concat_ws('|', CAST(c_nationkey AS VARCHAR), c_mktsegment) AS participant_label,
  concat_ws('|', CAST(c_nationkey AS VARCHAR), c_mktsegment, 'T' || CAST(year(o_orderdate) % 2 AS VARCHAR)) AS specimen_label,
  c_mktsegment AS disease, r_name AS study_name, CAST(o_orderdate AS DATE) AS order_date, p_brand AS v_gene, p_type AS j_gene,
  CASE l_returnflag WHEN 'A' THEN 'IGHA' WHEN 'N' THEN 'IGHD-M' WHEN 'R' THEN 'IGHG' ELSE l_returnflag END AS isotype_supergroup,
  l_partkey AS igh_or_tcrb_clone_id, CAST(l_quantity AS BIGINT) AS num_reads, l_discount AS v_mut,
  CASE WHEN l_partkey % 3 = 0 THEN concat(substr({_BASE}, 1, l_partkey % 8), 'W', substr({_BASE}, CAST(l_partkey % 8 + 2 AS BIGINT))) ELSE {_BASE} END AS cdr3_seq_aa_q_trim
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
"""


def sql(body: str) -> str:
    """A statement over the role table ``r``; further common tables may follow the comma."""
    return f"WITH r AS ({ROLE_SQL})" + (body if body.lstrip().startswith(",") else "\n" + body)
