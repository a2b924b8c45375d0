"""Repeated word sequences, by winnowed seeds that are extended both ways."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

U = np.uint64
#: Words of a window, the shortest repeat that counts.
WINDOW = 13
#: Words of a seed; each window has its least seed as its anchor, so equal windows have equal anchors at the same place.
SEED = 4


@dataclass
class Runs:
    """Anchors of a batch: each with the windows whose anchor it is, first to last.

    ``context`` hashes all words of those windows: where it is equal, the seed
    extends both ways over all of them at once.
    """

    text: np.ndarray
    anchor: np.ndarray
    context: np.ndarray
    first: np.ndarray
    last: np.ndarray


def runs(hashes: np.ndarray, starts: np.ndarray, tables: textops.Tables) -> Runs:
    """Of a batch's word hashes, ``starts`` being the first word of each text and the end."""
    seeds = textops.windows(hashes, SEED, 53)
    n, inside = hashes.size - WINDOW + 1, WINDOW - SEED + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Runs(none, none.astype(U), none.astype(U), none, none)
    least, at = seeds[:n].copy(), np.arange(n)
    for j in range(1, inside):
        lower = seeds[j : j + n] <= least
        np.copyto(least, seeds[j : j + n], where=lower)
        at[lower] = np.flatnonzero(lower) + j
    text = np.repeat(np.arange(starts.size - 1), np.diff(starts))
    valid = np.flatnonzero(text[:n] == text[WINDOW - 1 :][:n])
    new = np.ones(valid.size, bool)
    new[1:] = (np.diff(valid) > 1) | (np.diff(at[valid]) != 0)
    heads = np.flatnonzero(new)
    first, last = valid[heads], valid[np.append(heads[1:], valid.size) - 1] if valid.size else valid
    tables.grow(hashes.size + 1)
    sums = np.zeros(hashes.size + 1, U)
    np.cumsum(hashes * tables.powers[: hashes.size], out=sums[1:])
    whole = (sums[last + WINDOW] - sums[first]) * tables.unpowers[first]
    shape = ((at[first] - first) + 64 * (last - first)).astype(U)
    return Runs(text[first], seeds[at[first]], textops.splitmix(whole + textops.splitmix(shape)), first, last)


def seeds(texts: DataFrame) -> DataFrame:
    """(anchor, context, doc_id) of every anchor, equal ones of a text once."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tables = textops.Tables()
        for b in batches:
            raw, ids = b.column("raw").to_pylist(), b.column("doc_id")
            for lo, hi in textops.steps(raw):
                hashes, starts, _, _ = textops.words(raw[lo:hi], tables, lower=False)
                r = runs(hashes, starts, tables)
                # Once for each text: a phrase said over and over has the same anchor each time.
                once = np.unique(textops.splitmix(r.anchor ^ textops.splitmix(r.context + r.text.astype(U))), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(r.anchor[once].view(np.int64)), pa.array(r.context[once].view(np.int64)), ids.take(pa.array(r.text[once] + lo))], ["anchor", "context", "doc_id"])

    return texts.select("doc_id", "raw").mapInArrow(run, f"anchor long, context long, doc_id {kind}")


def once(anchors: np.ndarray, windows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct (anchor, window) and where each starts; a phrase said over and over is one window."""
    order = np.lexsort((starts, windows, anchors))
    a, w = anchors[order], windows[order]
    new = np.ones(a.size, bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    heads = np.flatnonzero(new)
    return a[heads], w[heads], np.split(starts[order], heads[1:]) if heads.size else []


def extended(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per text: ranges of repeated windows' starts, and (anchor, window, starts) of those yet to be compared, each window of a text once."""

    def run(batches):
        tables = textops.Tables()
        for b in batches:
            raw, docs, whole, part = (b.column(c) for c in ("raw", "doc", "whole", "part"))
            raw = raw.to_pylist()
            for lo, hi in textops.steps(raw):
                hashes, starts, _, _ = textops.words(raw[lo:hi], tables, lower=False)
                r = runs(hashes, starts, tables)
                grams = textops.windows(hashes, WINDOW, 59)
                ends = np.searchsorted(r.text, np.arange(hi - lo + 1))
                ranges, keys = [], []
                for i in range(hi - lo):
                    own = slice(ends[i], ends[i + 1])
                    anchor, base = r.anchor[own].view(np.int64), starts[i]
                    sure = np.isin(anchor, whole[lo + i].values.to_numpy())
                    open_ = np.flatnonzero(np.isin(anchor, part[lo + i].values.to_numpy()))
                    ranges.append((np.stack([r.first[own][sure], r.last[own][sure]], axis=1) - base).ravel())
                    first, size = r.first[own][open_], (r.last[own] - r.first[own])[open_] + 1
                    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if size.size else np.zeros(0, np.int64)
                    keys.append(once(np.repeat(anchor[open_], size), grams[at].view(np.int64), at - base))
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo), pa.array(ranges, pa.list_(pa.int64())),
                        *[pa.array([k[j] for k in keys], pa.list_(pa.int64())) for j in range(2)], pa.array([k[2] for k in keys], pa.list_(pa.list_(pa.int64()))),
                    ],
                    ["doc", "doc_id", "ranges", "anchors", "windows", "starts"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    joined = texts.join(wanted.hint("shuffle_hash"), "doc_id").select("doc", "doc_id", "raw", "whole", "part")
    return joined.mapInArrow(run, f"doc binary, doc_id {kind}, ranges array<long>, anchors array<long>, windows array<long>, starts array<array<long>>")


def repeats(texts: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(doc, ranges, starts): where windows begin that a document of a smaller id holds too."""
    known = texts.where(F.col("doc_id").isNotNull())
    found = seeds(known)
    shared = (
        found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("context").alias("x"), F.max("context").alias("y"))
        .where("low < high").select("anchor", "low", (F.col("x") == F.col("y")).alias("alike"))
    )
    # Where all contexts of an anchor are alike, every later document repeats all its windows; else its windows are compared one by one.
    met = found.select("anchor", "doc_id").join(shared, "anchor").where(~F.col("alike") | (F.col("doc_id") > F.col("low")))
    wanted = scratch.cut(
        met.groupBy("doc_id").agg(  # a document's own anchors
            F.collect_set(F.when(F.col("alike"), F.col("anchor"))).alias("whole"), F.collect_set(F.when(~F.col("alike"), F.col("anchor"))).alias("part")
        )
    )
    scratch.release()
    spread = scratch.cut(extended(known, wanted))
    scratch.release()
    windows = spread.select("doc", "doc_id", F.explode(F.arrays_zip("anchors", "windows", "starts")).alias("w")).select("doc", "doc_id", "w.*")
    firsts = windows.groupBy("anchors", "windows").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    later = windows.join(firsts.drop("high"), ["anchors", "windows"]).where(F.col("doc_id") > F.col("low"))
    starts = later.groupBy("doc").agg(F.flatten(F.collect_list("starts")).alias("starts"))  # a document's own windows
    out = scratch.cut(spread.select("doc", "ranges").dropDuplicates(["doc"]).join(starts, "doc", "left").where((F.size("ranges") > 0) | F.col("starts").isNotNull()))
    scratch.drop(wanted, spread)
    scratch.release()
    return out


def covered(n: int, ranges: list[int], starts: list[int]) -> np.ndarray:
    """Mask of n words, true where a repeated window lies."""
    step = np.zeros(n + 1, np.int64)
    pairs = np.array(ranges, np.int64).reshape(-1, 2)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 1] + WINDOW, -1)
    at = np.array(starts, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return np.cumsum(step[:n]) > 0


def spans(mask: np.ndarray) -> list[list[int]]:
    """(begin, end) of the maximal true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (begin, end in words) and kept_text of each row.

    Words are runs of other bytes than ASCII white space, unchanged.  A word goes
    if a window of 13 words over it also begins in a document of a smaller id;
    spans are the maximal repeats that windows make up.  All is judged on the
    input.  Kept words are joined by one space.

    Null and empty texts have no words.  Null ids have no order: those rows are
    kept whole and take nothing from others.  Rows that share an id don't take
    from each other; each is returned.  An empty table gives an empty result.
    Further columns aren't read.
    """
    scratch = common.Scratch(df.sparkSession, "substring")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = common.ids_and_text(df, id_col, text_col).select(
        "doc_id", F.encode(text, "UTF-8").alias("raw"), F.unhex(F.md5(F.concat_ws("\x00", F.col("doc_id").cast("string"), text))).alias("doc")
    )
    gone = repeats(texts, scratch)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for raw, ranges, starts in zip(*(b.column(c).to_pylist() for c in ("raw", "ranges", "starts")), strict=True):
                words = raw.split()
                if not ranges and not starts:
                    rows.append((len(words), 0, [], b" ".join(words).decode()))
                    continue
                mask = covered(len(words), ranges or [], starts or [])
                rows.append((len(words), int(mask.sum()), spans(mask), b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m).decode()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *map(pa.array, columns, (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()))], ["doc_id", "n_words", "n_removed", "spans", "kept_text"]
            )

    joined = texts.join(gone.hint("shuffle_hash"), "doc", "left").select("doc_id", "raw", "ranges", "starts")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, spans array<array<long>>, kept_text string")


def op2_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
