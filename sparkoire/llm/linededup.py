"""Near-duplicate lines by a deletion-neighbourhood join on words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

U = np.uint64
#: Words from which on a line may differ by one edit, a fifth of it at most; shorter ones must be equal.
EDIT_WORDS = 5


class Stretches:
    """Hashes of stretches of words of a batch, from running sums: a stretch's hash doesn't depend on its place."""

    def __init__(self, words: np.ndarray, tables: textops.Tables):
        tables.grow(words.size + 1)
        self.sums, self.unpowers = np.zeros(words.size + 1, U), tables.unpowers
        self.down = tables.inverse
        np.cumsum(words * tables.powers[: words.size], out=self.sums[1:])

    def sealed(self, total: np.ndarray, begin: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
        return textops.splitmix(total * self.unpowers[begin] + textops.splitmix(length.astype(U) + U(seed)))

    def of(self, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return self.sealed(self.sums[end] - self.sums[begin], begin, end - begin, seed)

    def without(self, begin: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of the stretch with one word left out; the same as of the stretch that is left."""
        rest = (self.sums[word] - self.sums[begin]) + (self.sums[end] - self.sums[word + 1]) * self.down
        return self.sealed(rest, begin, end - begin - 1, 0)


def halves(stretches: Stretches, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keys of each line's first and last half, at its length n and at n - 1.

    Of two lines within one word edit, the edit lies past the first half or
    before the last half of the shorter length, so they share one of the keys.
    """
    n, out = end - begin, []
    for length in (n, n - 1):
        half = length // 2
        out += [textops.splitmix(h + length.astype(U) * U(4) + U(k)) for k, h in enumerate((stretches.of(begin, begin + half), stretches.of(end - half, end)))]
    return np.stack(out, axis=1)


def variants(stretches: Stretches, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all lines in a row: hash of the line itself, then of it with each one word left out; and how many there are for each."""
    size = end - begin + 1
    line = np.repeat(np.arange(begin.size), size)
    place = np.arange(line.size) - np.repeat(np.cumsum(size) - size, size)
    word = begin[line] + np.maximum(place - 1, 0)
    out = stretches.without(begin[line], end[line], word)
    out[place == 0] = stretches.of(begin, end)
    return out, size


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word inserted, left out or replaced at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    least = min(len(a), len(b))
    i = j = 0
    while i < least and a[i] == b[i]:
        i += 1
    while j < least - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def spread(texts: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: its place, its identity and the keys of its halves."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tables = textops.Tables()
        for b in batches:
            raw = b.column("raw").to_pylist()
            for lo, hi in textops.steps(raw):
                split = [t.split(b"\n") for t in raw[lo:hi]]
                sizes = np.array([len(x) for x in split])
                row, number = np.repeat(np.arange(lo, hi), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                words, first, _, _ = textops.words([line for x in split for line in x], tables, lower=False)
                filled = np.flatnonzero(np.diff(first))
                begin, end = first[:-1][filled], first[1:][filled]
                one = Stretches(words, tables)
                two = Stretches(textops.splitmix(words + U(41)), tables)
                ids = np.stack([one.of(begin, end, 43), two.of(begin, end, 47)], axis=1).tobytes()
                keys = halves(one, begin, end).view(np.int64)
                at, near = pa.array(row[filled]), end - begin >= EDIT_WORDS
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(at), b.column("doc").take(at), pa.array(number[filled].astype(np.int32)), pa.array([ids[i : i + 16] for i in range(0, len(ids), 16)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(4 * near)]).astype(np.int32)), pa.array(keys[near].ravel())),
                    ],
                    ["doc_id", "doc", "line_no", "line", "keys"],
                )

    return texts.select("doc_id", "doc", "raw").mapInArrow(run, f"doc_id {kind}, doc binary, line_no int, line binary, keys array<long>")


def neighbourhoods(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, words, variants) of the wanted lines (doc, line_no, line)."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("line_no", "line")).alias("wanted"))  # a document's own lines

    def run(batches):
        tables = textops.Tables()
        for b in batches:
            raw, wanted = b.column("raw").to_pylist(), b.column("wanted").to_pylist()
            for lo, hi in textops.steps(raw):
                ids, mine = [], []
                for text, want in zip(raw[lo:hi], wanted[lo:hi], strict=True):
                    lines = text.split(b"\n")
                    ids += [w["line"] for w in want]
                    mine += [lines[w["line_no"]] for w in want]
                words, first, _, _ = textops.words(mine, tables, lower=False)
                keys, size = variants(Stretches(words, tables), first[:-1], first[1:])
                lists_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([b" ".join(m.split()) for m in mine], pa.binary()), lists_of], ["line", "words", "variants"])

    return texts.join(lists.hint("shuffle_hash"), "doc").select("raw", "wanted").mapInArrow(run, "line binary, words binary, variants array<long>")


def earlier_neighbours(around: DataFrame, firsts: DataFrame) -> DataFrame:
    """(line, other): for each line, at most a few earlier lines that may be within one edit, one of them if there is any.

    Most variants belong to one line alone; they are dropped by an aggregate
    before places are looked up.  Lines with one word replaced share the variant
    without that word and its place; all of them are within one edit of each
    other, so the earliest will do.  A line and a longer one share the shorter's
    own hash: the shorter one and the earliest of the longer ones stand for the rest.
    """
    every = around.select("line", F.posexplode("variants").alias("at", "variant"))
    shared = every.groupBy("variant").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x != y").select("variant")
    emitted = every.join(shared, "variant", "left_semi").join(firsts, "line")
    shorter = emitted.where("at > 0")
    replaced = shorter.groupBy("variant", "at").agg(F.min_by("line", "first").alias("other"), F.count("*").alias("n")).where("n > 1")
    whole = emitted.where("at = 0").select("variant", F.col("line").alias("whole"), F.col("first").alias("whole_first"))
    same_place = shorter.join(replaced, ["variant", "at"]).select("line", "other")
    grown = shorter.join(whole, "variant")
    to_short = grown.where(F.col("whole_first") < F.col("first")).select("line", F.col("whole").alias("other"))
    to_long = grown.groupBy("whole", "whole_first").agg(F.min("first").alias("low"), F.min_by("line", "first").alias("other"))
    to_long = to_long.where(F.col("low") < F.col("whole_first")).select(F.col("whole").alias("line"), "other")
    return same_place.union(to_short).union(to_long).where("line != other").distinct()


def repeated_lines(texts: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(doc, line_no) of the lines that an earlier line equals or nearly equals.

    Each table is deleted as soon as nothing reads it any more, so that few of
    them lie beside a shuffle of whole texts.
    """
    place = F.struct("doc_id", "doc", "line_no")
    lines = scratch.cut(spread(texts))
    distinct = scratch.cut(lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    scratch.release()
    again = scratch.cut(lines.join(distinct.where("n > 1").select("line", "first"), "line").where(place != F.col("first")).select("doc", "line_no"))
    scratch.drop(lines)
    scratch.release()
    keyed = distinct.select("line", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x != y").select("key")
    candidates = scratch.cut(keyed.join(shared, "key", "left_semi").select("line").distinct())
    scratch.release()
    wanted = scratch.cut(distinct.join(candidates, "line", "left_semi").select("line", "first"))
    scratch.drop(distinct, candidates)
    scratch.release()
    around = scratch.cut(neighbourhoods(texts, wanted.select("line", "first.doc", "first.line_no")))
    scratch.release()
    pairs = scratch.cut(earlier_neighbours(around, wanted))
    scratch.release()
    words = around.select("line", "words")
    both = pairs.join(words, "line").join(words.select(F.col("line").alias("other"), F.col("words").alias("others")), "other")

    def run(batches):
        for b in batches:
            ok = [within_one(x.split(b" "), y.split(b" ")) for x, y in zip(b.column("words").to_pylist(), b.column("others").to_pylist(), strict=True)]
            yield b.select(["line"]).filter(pa.array(ok, pa.bool_()))

    near = both.select("line", "words", "others").mapInArrow(run, "line binary").distinct()
    dropped = scratch.cut(wanted.join(near, "line", "left_semi").select("first.doc", "first.line_no"))
    scratch.drop(wanted, around, pairs)
    return dropped.union(again)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    Lines are split at line feeds.  A line goes if an earlier one, in the order
    (id, md5 of id and text, line number), has the same words, or if both have
    EDIT_WORDS words or more and one word inserted, left out or replaced turns
    one into the other; both are judged on the input.  The earliest stays.  Blank
    lines stay.  White space inside a line doesn't count, and kept lines are
    returned byte for byte.

    Null text stays null and has no lines; an empty text has one empty line that
    stays.  Null ids sort first.  Rows of one id and text are one document: each
    is returned with the same lines.  Other columns are carried along; names that
    clash with the added ones raise an error.  An empty table gives an empty result.
    """
    common.need(df, id_col, text_col)
    if clash := {"kept_text", "n_lines", "n_dropped", "_doc", "_drop"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are added by this operator")
    scratch = common.Scratch(df.sparkSession, "lines")
    text = F.col(text_col).cast("string")
    doc: Column = F.unhex(F.md5(F.concat_ws("\x00", F.col(id_col).cast("string"), text)))
    texts = df.select(F.col(id_col).alias("doc_id"), doc.alias("doc"), F.encode(text, "UTF-8").alias("raw")).where(F.col("raw").isNotNull())
    gone = scratch.cut(repeated_lines(texts, scratch).groupBy("doc").agg(F.collect_set("line_no").alias("_drop")).withColumnRenamed("doc", "_doc"))
    scratch.release()
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_drop"), i))
    out = df.withColumn("_doc", doc).join(gone.hint("shuffle_hash"), "_doc", "left")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
