"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textops
from .components import components

U = np.uint64
SHINGLE = 5
#: 32 bands of 4 rows: a pair of similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature places compared at a time.
BATCH = 16
#: A candidate is pruned once its similarity is at least the threshold with a smaller posterior probability.
MISS = 1e-6
#: Members of a bucket that one task compares at a time.
BLOCK = 512


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes; a shorter text is one shingle, no words give none."""
    if not hashes.size:
        return np.zeros(0, U)
    if hashes.size < SHINGLE:
        return np.array([textops.sequence(hashes, 3)], U)
    return np.unique(textops.windows(hashes, SHINGLE, 5))


def each_text(texts: list[bytes], tables: textops.Tables):
    """Shingle sets of texts, in order."""
    for a, b in textops.steps(texts):
        hashes, first, _, _ = textops.words(texts[a:b], tables, lower=True)
        for i in range(b - a):
            yield shingles(hashes[first[i] : first[i + 1]])


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit minima of HASHES hash functions for each (not empty) set."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([s.size for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for j, (m, c) in enumerate(zip(textops.constants(HASHES, 11) | U(1), textops.constants(HASHES, 13), strict=True)):
        out[:, j] = np.minimum.reduceat(((flat * m + c) >> U(32)).astype(np.uint32), at)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = signatures.astype(U).reshape(len(signatures), BANDS, ROWS) * (textops.constants(ROWS, 17) | U(1))
    return textops.splitmix(parts.sum(axis=2, dtype=U) + textops.constants(BANDS, 19)).view(np.int64)


@functools.cache
def least_matches(threshold: float, miss: float, batch: int = BATCH, hashes: int = HASHES) -> tuple[int, ...]:
    """Per number of batches: the fewest agreeing places with which a pair goes on.

    With a uniform prior, m of n agreeing places leave a Beta(m + 1, n - m + 1)
    posterior; the pair is pruned where P(similarity >= threshold) < miss.  That
    tail is a binomial sum: P(Beta(a, b) >= t) = P(Binomial(a + b - 1, t) <= a - 1).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Row by row, whether two signatures pass every batch's bound; pruned rows aren't compared further."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold, miss)):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        seen[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
        alive = alive[seen[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def as_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def describe(texts: DataFrame) -> DataFrame:
    """doc_id, hash of the text, set size, signature and band keys."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tables = textops.Tables()
        for b in batches:
            ids, hashes, raw = b.column("doc_id"), b.column("hash"), [t or b"" for t in b.column("raw").to_pylist()]
            sets, rows = [], []
            for s in each_text(raw, tables):
                sets.append(s)
            rows = [i for i, s in enumerate(sets) if s.size]
            sigs: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            step = 512
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                sig = signature([sets[i] for i in part])
                for i, s, k in zip(part, sig, bands(sig), strict=True):
                    sigs[i], keys[i] = s.tobytes(), k
            yield pa.RecordBatch.from_arrays(
                [ids, hashes, pa.array([s.size for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "hash", "n_shingles", "signature", "bands"],
            )

    return texts.select("doc_id", F.md5("raw").alias("hash"), "raw").mapInArrow(run, f"doc_id {kind}, hash string, n_shingles long, signature binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, scratch: common.Scratch) -> DataFrame:
    """Those (a, b) whose whole sets are similar enough; in integers, 100 * common >= 100 * threshold * union."""
    per_cent = round(100 * threshold)
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    there = scratch.cut(texts.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "raw"))
    both = (
        pairs.join(there.select(F.col("doc_id").alias("a"), F.col("raw").alias("raw_a")), "a")
        .join(there.select(F.col("doc_id").alias("b"), F.col("raw").alias("raw_b")), "b")
    )
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        tables = textops.Tables()
        for batch in batches:
            raw_a, raw_b = batch.column("raw_a").to_pylist(), batch.column("raw_b").to_pylist()
            distinct = list(dict.fromkeys(raw_a + raw_b))
            sets = dict(zip(distinct, each_text(distinct, tables), strict=True))
            keep = []
            for x, y in zip(raw_a, raw_b, strict=True):
                p, q = sets[x], sets[y]
                shared = np.intersect1d(p, q, assume_unique=True).size
                keep.append(bool(shared) and 100 * shared >= per_cent * (p.size + q.size - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = scratch.cut(both.select("a", "b", "raw_a", "raw_b").mapInArrow(run, f"a {kind}, b {kind}"))
    scratch.drop(there)
    return out


def plausible(pairs: DataFrame, nodes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Those (a, b) that the sequential test doesn't prune."""
    both = (
        pairs.join(nodes.select(F.col("id").alias("a"), F.col("signature").alias("sig_a")), "a")
        .join(nodes.select(F.col("id").alias("b"), F.col("signature").alias("sig_b")), "b")
    )
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.select(["a", "b"]).filter(pa.array(survives(as_signatures(b.column("sig_a")), as_signatures(b.column("sig_b")), threshold, miss)))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def links_of(left: np.ndarray, right: np.ndarray, component: np.ndarray, sigs: np.ndarray, keys: np.ndarray, key: int, sets: list[np.ndarray], threshold: float, miss: float) -> list[tuple[int, int]]:
    """Verified links (i, j), i in left and j in right, that join components.

    A pair is tested in the first bucket that it shares, and only while its
    components are apart; so a tight group costs a link for each member, and no
    pair that isn't a link leaves the task.
    """
    per_cent, sizes = round(100 * threshold), np.array([s.size for s in sets])
    component, found = component.copy(), []
    for i in left.tolist():
        others = right[(right > i) & (component[right] != component[i])] if left is right else right[component[right] != component[i]]
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * low >= per_cent * high]
        others = others[survives(np.broadcast_to(sigs[i], (others.size, HASHES)), sigs[others], threshold, miss)]
        same = keys[others] == keys[i]
        others = others[keys[i][same.argmax(axis=1)] == key] if others.size else others
        for j in others.tolist():
            if component[i] != component[j]:
                shared = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                if 100 * shared >= per_cent * (sizes[i] + sizes[j] - shared):
                    found.append((i, j))
                    component[component == component[j]] = component[i]
    return found


def across(members: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, miss: float, scratch: common.Scratch) -> DataFrame:
    """Links between different components within buckets (key, id, component).

    A bucket is cut into blocks of about BLOCK members; each pair of blocks meets
    in a task of its own with signatures and texts.
    """
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    there = scratch.cut(
        texts.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.md5("raw").alias("hash"), "raw")
        .join(nodes.hint("shuffle_hash"), ["id", "hash"]).select("id", "raw", "signature", "bands")
    )
    # A hot bucket's members stay where they lie until they are dealt to blocks.
    sizes = scratch.cut(members.groupBy("key").agg(F.count("*").alias("n")))
    sized = members.join(common.sent_if_small(sizes), "key")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    placed = sized.select("key", "id", "component", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.select(
        "key", "id", "component", "block",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))).alias("pair"),
    ).join(there, "id")
    kind = members.schema["id"].dataType.simpleString()

    def run(key, table):
        ids, block = table.column("id").combine_chunks(), table.column("block").to_numpy()
        component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        left = np.flatnonzero(block == key[1].as_py())
        right = left if key[1] == key[2] else np.flatnonzero(block == key[2].as_py())
        keys = np.array(table.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
        sets = list(each_text(table.column("raw").to_pylist(), textops.Tables()))
        found = links_of(left, right, component, as_signatures(table.column("signature")), keys, key[0].as_py(), sets, threshold, miss)
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j))})

    grouped = met.select("key", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "block", "id", "component", "signature", "bands", "raw").groupBy("key", "low", "high")
    out = scratch.cut(grouped.applyInArrow(run, f"a {kind}, b {kind}"))
    scratch.drop(there)
    return out


def near_duplicates(df: DataFrame, threshold: float = 0.75, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row.

    Words are lower-cased (A-Z) runs of other bytes than ASCII white space; a
    document's set holds its distinct 5-word shingles, a shorter one the whole
    sequence.  Documents whose sets are similar by ``threshold`` are linked.

    Equal texts are one node.  In every band's bucket the members are compared
    with its smallest id; links found make components; then members of the same
    bucket in different components are compared too, so that any candidate pair
    is either tested or joined already.

    Null or empty texts, or texts of white space, have an empty set, link with
    nothing and are kept.  Null ids link with nothing; their component is null
    and they are kept.  Rows that share an id are one document, linked to all
    that any of its texts links to; each row is returned.  Ties can't arise: the
    smallest id stands for a component.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = common.Scratch(spark, "neardup")
    texts = common.ids_and_text(df, id_col, text_col).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    described = scratch.cut(describe(texts))
    full = described.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = scratch.cut(full.groupBy("hash").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands")))
    # The plans that move whole texts are the same at every size: one hash exchange, no sort.
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = scratch.cut(keyed.join(shared, "key").select("key", "low", "id"))
    stars = members.where("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    sources = texts.where(F.col("doc_id").isNotNull())
    first = verified(scratch.cut(plausible(stars, nodes, threshold, miss)), sources, threshold, scratch)
    scratch.release()
    copies = full.join(nodes.select("hash", "id"), "hash").where("doc_id != id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    linked = scratch.cut(components(first.union(copies), scratch))
    marked = members.select("key", "id").distinct().join(linked, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = marked.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    second = across(scratch.cut(marked.join(common.sent_if_small(scratch.cut(mixed)), "key", "left_semi")), nodes, sources, threshold, miss, scratch)
    scratch.release()
    if not second.isEmpty():
        linked = scratch.cut(components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(second), scratch))
    out = described.select("doc_id", "n_shingles").join(linked.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of the smallest id of each component; the least one by its columns in JSON, if several share that id.  Rows with null ids stay."""
    found = common.Scratch(df.sparkSession, "neardup").cut(near_duplicates(df, threshold).select("doc_id", "kept"))
    kept = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    out = df.join(kept.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
    several = kept.where("n > 1").select("doc_id")
    if not several.isEmpty():
        order = Window.partitionBy("doc_id").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        least = out.join(several, "doc_id", "left_semi").withColumn("_least", F.row_number().over(order)).where("_least = 1").drop("_least")
        out = out.join(several, "doc_id", "left_anti").union(least)
    return out.union(df.where(F.col("doc_id").isNull()))


def op1_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
