"""Repeated byte strings by suffix arrays, built with the difference-cover algorithm on independent parts.

Every string of LENGTH bytes has its least SEED-gram as its anchor, so equal
strings meet under equal anchors.  The strings of one anchor that follow each
other are a stretch, and all its bytes are the stretch's context.  Stretches of
anchors that occur once hold nothing that repeats.  Of equal contexts two
stretches stand for the rest and are compared byte by byte; one of them, and the
contexts that occur once beside others of their anchor, go on.  Anchors deal
these to parts; each part's suffixes are sorted on their own, and neighbours in
that order are compared byte by byte.  Nothing goes that no comparison of bytes
has found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

U = np.uint64
LENGTH = 400
SEED = 32
#: Bytes that one suffix array sorts, about; a larger anchor is split by where its strings begin before it.
PART = 1 << 20
#: Bytes of an anchor's distinct contexts from which on its strings are told apart one by one.
HOT = 4 * PART


def names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 0 of tuples in the columns, and their number.  Columns hold numbers that aren't negative."""
    key = columns[0]
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + c
    places = int(key.size).bit_length()
    if int(key.max(initial=0)) >> (62 - places):
        distinct, rank = np.unique(key, return_inverse=True)
        return rank.astype(np.int64), distinct.size
    # Place and key in one number: sorting numbers is faster than sorting places by them.
    both = np.sort(key << places | np.arange(key.size))
    new = np.diff(both >> places, prepend=-1) > 0
    rank = np.empty(key.size, np.int64)
    rank[both & ((1 << places) - 1)] = np.cumsum(new) - 1
    return rank, int(new.sum())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Begins of the suffixes of a sequence of positive numbers, in their order, by the difference cover {1, 2} modulo 3.

    Triples at the sampled places are sorted and named; unless all names differ,
    the sequence of names is sorted the same way.  The remaining suffixes are
    sorted by their first number and the rank behind it, and merged with the
    sampled ones: against places 1 by (number, rank), against places 2 by
    (number, number, rank).
    """
    n = s.size
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    rank, distinct = names(t[sampled], t[sampled + 1], t[sampled + 2])
    if distinct < sampled.size:
        order = suffix_array(rank + 1)
        rank = np.empty(sampled.size, np.int64)
        rank[order] = np.arange(sampled.size)
    by_place = np.zeros(n + 3, np.int64)
    by_place[sampled] = rank + 1
    zero = np.arange(0, n, 3)
    wide = sampled.size + 2
    pair = lambda i: t[i] * wide + by_place[i + 1]
    zero = zero[np.argsort(pair(zero), kind="stable")]
    ordered = np.empty(sampled.size, np.int64)
    ordered[rank] = sampled
    first, second = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before_one = np.searchsorted(pair(first), pair(zero))
    heads, _ = names(np.concatenate([t[zero], t[second]]), np.concatenate([t[zero + 1], t[second + 1]]))
    ranks = np.concatenate([by_place[zero + 2], by_place[second + 2]])
    triple = heads * wide + ranks
    before_two = np.searchsorted(triple[zero.size :], triple[: zero.size])
    out = np.empty(n + (sampled.size + zero.size - n), np.int64)
    at = np.arange(zero.size) + before_one + before_two
    taken = np.zeros(out.size, bool)
    taken[at] = True
    out[at] = zero
    out[~taken] = ordered
    return out[out < n]


def repeated(data: bytes, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Mask of the places of data at which a string of ``length`` bytes begins that also begins at another place.

    ``ends`` are the ends of the pieces that data is made of, no string crosses
    them: a number of its own stands for each.  Equal strings are neighbours in
    the suffix array; neighbours are compared by hash and then byte by byte.
    """
    raw = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], ends[:-1]])
    piece = np.repeat(np.arange(ends.size), ends - starts)
    s = np.insert(raw.astype(np.int64) + 1, ends, 257 + np.arange(ends.size))
    order = suffix_array(s)
    origin = np.insert(np.arange(raw.size), ends, -1)[order]
    order = origin[origin >= 0]
    order = order[order + length <= ends[piece[order]]]
    tables = textops.Tables()
    sums = textops.prefixes(raw, tables.codes, tables)
    hashes = (sums[order + length] - sums[order]) * tables.unpowers[order]
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    out = np.zeros(raw.size, bool)
    for cut in range(0, same.size, 4096):
        a, b = order[same[cut : cut + 4096]], order[same[cut : cut + 4096] + 1]
        view = np.lib.stride_tricks.sliding_window_view(raw, length)
        ok = (view[a] == view[b]).all(axis=1)
        out[a[ok]] = out[b[ok]] = True
    return out


@dataclass
class Stretches:
    """Anchors of a batch: the text, the anchor's place and hash, the first and last string it is the anchor of, and a hash of all their bytes."""

    text: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    context: np.ndarray
    first: np.ndarray
    last: np.ndarray


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, by running minima of blocks from both sides."""
    n = values.size
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(U).max, U)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(texts: list[bytes], tables: textops.Tables) -> Stretches:
    """Of the texts joined without gaps; begins and ends are places in the joined bytes."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = raw.size - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Stretches(none, none, none.astype(U), none.astype(U), none, none)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    sums = textops.prefixes(raw, tables.codes, tables)
    grams = textops.splitmix((sums[SEED:] - sums[:-SEED]) * tables.unpowers[: sums.size - SEED])
    bits = int(grams.size).bit_length()
    low = U((1 << bits) - 1)
    # Of equal grams the last counts: the place, turned round, fills the low bits.
    ranked = (grams & ~low) | (low - np.arange(grams.size, dtype=U))
    at = (low - (least_of(ranked, LENGTH - SEED + 1) & low)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n), "right")
    valid = np.flatnonzero(np.arange(n) + LENGTH <= ends[text])
    new = np.ones(valid.size, bool)
    new[1:] = (np.diff(valid) > 1) | (np.diff(at[valid]) != 0) | (np.diff(text[valid]) != 0)
    heads = np.flatnonzero(new)
    if not heads.size:
        return Stretches(none, none, none.astype(U), none.astype(U), none, none)
    first, last = valid[heads], valid[np.append(heads[1:], valid.size) - 1]
    place = at[first]
    whole = (sums[last + LENGTH] - sums[first]) * tables.unpowers[first]
    shape = ((place - first) * 1024 + (last - first)).astype(U)
    return Stretches(text[first], place, grams[place], textops.splitmix(whole + textops.splitmix(shape)), first, last)


def seeds(texts: DataFrame) -> DataFrame:
    """(anchor, context, doc, at, first, last) of every anchor; places are in bytes of the text."""

    def run(batches):
        tables = textops.Tables()
        for b in batches:
            raw, docs = b.column("raw").to_pylist(), b.column("doc")
            for lo, hi in textops.steps(raw):
                r = stretches(raw[lo:hi], tables)
                base = np.concatenate([[0], np.cumsum([len(t) for t in raw[lo:hi]])])[r.text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.anchor.view(np.int64)), pa.array(r.context.view(np.int64)), docs.take(pa.array(r.text + lo)), *[pa.array(x - base) for x in (r.at, r.first, r.last)]],
                    ["anchor", "context", "doc", "at", "first", "last"],
                )

    return texts.select("doc", "raw").mapInArrow(run, "anchor long, context long, doc binary, at long, first long, last long")


def single_strings(texts: DataFrame, hot: DataFrame, scratch: common.Scratch) -> DataFrame:
    """As `seeds`, of the hot stretches (doc, anchor, at, first, last): each string is a stretch of its own.

    The hash of a string takes the place of its context, so those that occur
    once fall away before bytes are moved, and two stand for all equal ones.
    """
    lists = scratch.cut(hot.groupBy("doc").agg(F.collect_set(F.struct("anchor", "at", "first", "last")).alias("wanted")))  # a document's own stretches
    texts = texts.join(common.sent_if_small(lists.select("doc")), "doc", "left_semi")

    def run(batches):
        tables = textops.Tables()
        for b in batches:
            docs = b.column("doc")
            for i, (raw, own) in enumerate(zip(b.column("raw").to_pylist(), b.column("wanted").to_pylist(), strict=True)):
                sums = textops.prefixes(np.frombuffer(raw, np.uint8), tables.codes, tables)
                first, last, at, anchor = (np.array([w[k] for w in own], np.int64) for k in ("first", "last", "at", "anchor"))
                size = last - first + 1
                begin = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)
                place = np.repeat(at, size)
                strings = (sums[begin + LENGTH] - sums[begin]) * tables.unpowers[begin]
                context = textops.splitmix(strings + textops.splitmix((place - begin).astype(U) + U(1 << 40)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(anchor, size)), pa.array(context.view(np.int64)), docs.take(pa.array(np.full(begin.size, i))), pa.array(place), pa.array(begin), pa.array(begin)],
                    ["anchor", "context", "doc", "at", "first", "last"],
                )

    held = texts.join(lists.hint("shuffle_hash"), "doc").select("doc", "raw", "wanted")
    return held.mapInArrow(run, "anchor long, context long, doc binary, at long, first long, last long")


def sorted_parts(texts: DataFrame, wanted: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(anchor, context, low, high): where, counted from the anchor, repeated strings begin in the wanted stretches.

    Two stretches of a context stand for all of them.  ``mixed`` marks those that
    other contexts of the anchor are compared with.
    """
    size = F.col("last") - F.col("first") + LENGTH
    weights = wanted.where("mixed").groupBy("anchor").agg(F.sum(size).alias("bytes"))
    total = wanted.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // PART))
    splits = F.least(F.lit(LENGTH - SEED + 1), F.ceil(F.coalesce("bytes", F.lit(1)) / PART))
    # Equal strings begin as far before their anchor: each split takes a range of that distance.
    cut = wanted.join(weights, "anchor", "left").withColumn("step", F.ceil(F.lit(LENGTH - SEED + 1) / splits))
    cut = cut.withColumn("split", F.explode(F.sequence(F.floor((F.col("at") - F.col("last")) / F.col("step")), F.floor((F.col("at") - F.col("first")) / F.col("step")))))
    nearest, farthest = F.col("split") * F.col("step"), (F.col("split") + 1) * F.col("step") - 1
    key = F.when(F.col("mixed"), F.xxhash64("anchor", "split")).otherwise(F.xxhash64("anchor", "context"))
    cut = cut.select(
        "doc", "anchor", "context", "mixed", "at", F.greatest("first", F.col("at") - farthest).cast("long").alias("first"), F.least("last", F.col("at") - nearest).cast("long").alias("last"),
        F.pmod(key, F.lit(parts)).alias("part"),
    )
    lists = cut.groupBy("doc").agg(F.collect_list(F.struct("part", "anchor", "context", "mixed", "at", "first", "last")).alias("wanted"))  # a document's own stretches

    def extract(batches):
        for b in batches:
            for raw, own in zip(b.column("raw").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["part"] for w in own], pa.int64()), pa.array([w["anchor"] for w in own], pa.int64()), pa.array([w["context"] for w in own], pa.int64()),
                        pa.array([w["mixed"] for w in own], pa.bool_()), pa.array([w["first"] - w["at"] for w in own], pa.int32()),
                        pa.array([raw[w["first"] : w["last"] + LENGTH] for w in own], pa.binary()),
                    ],
                    ["part", "anchor", "context", "mixed", "low", "bytes"],
                )

    schema = "part long, anchor long, context long, mixed boolean, low int, bytes binary"
    held = texts.join(lists.hint("shuffle_hash"), "doc").select("raw", "wanted").mapInArrow(extract, schema)

    def run(table):
        table = table.sort_by([("anchor", "ascending"), ("context", "ascending"), ("low", "ascending")])
        data, low = table.column("bytes").to_pylist(), table.column("low").to_numpy()
        keys = np.stack([table.column(c).to_numpy() for c in ("anchor", "context", "low")])
        alike = np.flatnonzero((keys[:, 1:] == keys[:, :-1]).all(axis=0)) + 1
        twice = np.array([i for i in alike.tolist() if data[i] == data[i - 1]], np.int64)
        chosen = np.flatnonzero(table.column("mixed").to_numpy(zero_copy_only=False) & ~np.isin(np.arange(len(data)), twice))
        some = [data[i] for i in chosen.tolist()]
        ends = np.cumsum([len(x) for x in some], dtype=np.int64)
        mask = repeated(b"".join(some), ends)
        # No run goes on into the next stretch: the last places of each have no whole string.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2)
        piece = np.searchsorted(ends, edge[:, 0], "right")
        start = low[chosen[piece]] + edge[:, 0] - np.concatenate([[0], ends[:-1]])[piece]
        rows = np.concatenate([twice, chosen[piece]])
        first = np.concatenate([low[twice], start])
        last = np.concatenate([low[twice] + np.array([len(data[i]) for i in twice.tolist()], np.int64) - LENGTH, start + edge[:, 1] - edge[:, 0] - 1])
        return pa.table({
            "anchor": table.column("anchor").take(pa.array(rows)), "context": table.column("context").take(pa.array(rows)),
            "low": pa.array(first.astype(np.int32)), "high": pa.array(last.astype(np.int32)),
        })

    return scratch.cut(held.groupBy("part").applyInArrow(run, "anchor long, context long, low int, high int"))


def repeats(texts: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(doc, ranges): first and last begins of repeated strings, a list of pairs for each document that has some."""
    found = scratch.cut(seeds(texts))
    one = F.struct("doc", "at", "first", "last")

    def distinct(stretches: DataFrame) -> DataFrame:
        n = F.count("*")
        return scratch.cut(stretches.groupBy("anchor", "context").agg(n.alias("n"), F.min(one).alias("x"), F.when(n > 1, F.max(one)).alias("y")))

    contexts = distinct(found)
    scratch.release()
    met = contexts.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("x.last") - F.col("x.first") + LENGTH).alias("bytes")).where("n > 1")
    met = scratch.cut(met.select("anchor", (F.col("kinds") > 1).alias("mixed"), (F.col("bytes") > HOT).alias("hot")))
    scratch.release()
    shared = contexts.join(met.where("not hot").drop("hot"), "anchor")
    if not met.where("hot").isEmpty():
        hot = common.sent_if_small(met.where("hot").select("anchor"))
        singles = scratch.cut(single_strings(texts, found.join(hot, "anchor").select("doc", "anchor", "at", "first", "last"), scratch))
        scratch.release()
        found = found.join(hot, "anchor", "left_anti").unionByName(singles)
        shared = shared.unionByName(distinct(singles).where("n > 1").withColumn("mixed", F.lit(False)))
    both = F.explode(F.when(F.col("n") > 1, F.array("x", "y")).otherwise(F.array("x")))
    wanted = scratch.cut(shared.select("anchor", "context", "mixed", both.alias("one")).select("anchor", "context", "mixed", "one.*"))
    scratch.drop(contexts)
    scratch.release()
    some = sorted_parts(texts, wanted, scratch)
    scratch.drop(wanted)
    scratch.release()
    ranges = found.join(some.distinct(), ["anchor", "context"]).select("doc", (F.col("at") + F.col("low")).alias("first"), (F.col("at") + F.col("high")).alias("last"))
    return scratch.cut(ranges.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("ranges")))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (begin, end in bytes, maximal) and the kept bytes of each row.

    Texts are UTF-8 bytes.  A byte goes if a string of LENGTH bytes over it also
    begins at any other place of the table, the same row included; overlaps
    count.  All is judged on the input, and no string crosses rows.

    Null and empty texts have no bytes.  Null ids take part like others.
    Repeated rows repeat each other.  An empty table gives an empty result.
    Kept bytes may cut a character in two, so they are binary.  Further columns
    aren't read.
    """
    spark = df.sparkSession
    scratch = common.Scratch(spark, "suffix")
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.unhex(F.md5(F.concat_ws("\x00", F.col("doc_id").cast("string"), text)))
    texts = common.ids_and_text(df, id_col, text_col).select("doc_id", F.encode(text, "UTF-8").alias("raw"), doc.alias("doc"))
    gone = repeats(texts, scratch)
    scratch.release()
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for raw, ranges in zip(b.column("raw").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                step = np.zeros(len(raw) + 1, np.int64)
                for r in ranges or []:
                    step[r["first"]] += 1
                    step[r["last"] + LENGTH] -= 1
                mask = np.cumsum(step[:-1]) > 0
                spans = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2)
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes() if ranges else raw
                rows.append((len(raw), int(mask.sum()), spans.tolist(), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *map(pa.array, columns, (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()))], ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
            )

    joined = texts.join(gone.hint("shuffle_hash"), "doc", "left").select("doc_id", "raw", "ranges")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept binary")


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
