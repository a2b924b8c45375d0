"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kind, pattern, group that holds the value, least characters of that value; in the order of ties.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Longer runs of key characters; the method adds those that mix letters and digits and stay with few owners.
GENERIC = ("generic", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
KINDS = [k[0] for k in (*BASE, GENERIC)]
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def found(text: Column, kind: tuple, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches, those with short values dropped.

    ``split`` gives the pieces between matches, so a match begins at the lengths
    of the pieces up to it and of the matches before it.  ``[0-9a-f]{24,}`` takes
    the same spans as whole runs of which the short are dropped.
    """
    _, pattern, group, least = kind
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(matches.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("p"))

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        value = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), value.alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(F.length(value) >= least, one).otherwise(F.array().cast(SPAN))).alias("out"))

    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def scan(df: DataFrame, max_owners: int = 2, max_repositories: int = 20, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """Per row: counts of base kinds, the base digest, all spans, and how many of them look live or copied.

    Candidate values (base and generic) are hashed and counted over the whole
    corpus by distinct repositories and distinct owners.  A value that more than
    ``max_owners`` owners hold is a copied example, and so is one that few owners
    hold in more than ``max_repositories`` repositories; one of few owners in few
    places looks live.
    Generic candidates become spans only if they look live, mix letters and
    digits and overlap no base span; base spans always stay.

    Null or empty text: no spans, the digest of an empty string, spans ''.  Null
    owner or repository: counts as one owner or repository of its own, the null
    one.  Repeated rows are scanned and returned each, and count once as an owner.
    Null ids are kept.  An empty table gives an empty result.
    """
    common.need(df, id_col, text_col, repository_col, owner_col)
    scratch = common.Scratch(df.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = df.select(
        F.col(id_col).alias("doc_id"), text.alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(repository_col).cast("string")), F.lit("")).alias("repository"),
        F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"),
    )
    kinds = [found(F.col("text"), k, i) for i, k in enumerate((*BASE, GENERIC))]
    each = plain.select("doc_id", "repository", "owner", *[s.alias(n) for s, n in zip(kinds, KINDS)])
    base = F.concat("assign", "access", "hex")
    added = F.filter(
        "generic",
        lambda g: g["value"].rlike("[0-9]") & g["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"])),
    )
    each = scratch.cut(
        each.withColumn("base", base).select("doc_id", "repository", "owner", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], "base", added.alias("more"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    candidates = each.select("row", "repository", "owner", F.explode(F.concat("base", "more")).alias("s")).select("row", "repository", "owner", "s", F.sha2(F.col("s")["value"], 256).alias("hash"))
    held = scratch.cut(candidates.select("hash", "repository", "owner").distinct())
    owners = (
        held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
        .groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_holdings"))
    )
    repositories = held.groupBy("hash", "repository").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_repositories"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    judged = candidates.join(owners.join(repositories, "hash"), "hash").withColumn("live", live)
    kept = judged.where(F.col("live") | (F.col("s")["rank"] < len(BASE)))
    by_row = kept.groupBy("row").agg(
        F.collect_list("s").alias("all"), F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_copied"),
        F.max("n_holdings").alias("most_holdings"),
    )
    none = F.lit(0).cast("long")
    return each.join(by_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(listed(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_copied", none).alias("n_copied"), F.coalesce("most_holdings", none).alias("most_holdings"),
    )


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
