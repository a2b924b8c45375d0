"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, textops

U = np.uint64
#: Word edits (inserted, left out, replaced) that a copy may have, as a share of an item's words.
EDIT_RATE = 0.2
#: Random walks, samples of each walk's embedding, and symbols in a sample.
#: Measured recall of pairs at the edit bound is over 0.99 (tests/llm/test_results.py).
WALKS, SAMPLES, PLACES = 8, 12, 2
#: Text of items that one scan of the documents takes along; more items go in further scans.
BLOCK_BYTES = 16 << 20


def embed(x: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding of the rows of x (words as symbols, sizes words each) into 3 symbols a word.

    At each step the symbol under the pointer is written, and a random bit of the
    step and that symbol decides whether the pointer moves on; past the end
    zeros are written.  Strings in step stay in step, an edit sets them apart
    until their walks meet again.
    """
    m, n = x.shape
    padded = np.concatenate([x, np.zeros((m, 1), U)], axis=1)
    out, at, rows = np.empty((m, 3 * n), U), np.zeros(m, np.int64), np.arange(m)
    for t, noise in enumerate(textops.constants(3 * n, 101 + walk)):
        out[:, t] = symbol = padded[rows, at]
        at = np.minimum(at + (textops.splitmix(symbol ^ noise) >> U(63)).astype(np.int64), sizes)
    return out


def keys(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One key for each row of x and table: PLACES sampled symbols of an embedding, hashed.

    Which symbols a table samples follows the row's size alone.
    """
    m = len(x)
    out = np.empty((m, WALKS * SAMPLES), U)
    kinds = [(n, np.flatnonzero(sizes == n), np.random.default_rng(n).integers(0, 3 * n, (WALKS, SAMPLES, PLACES))) for n in np.unique(sizes).tolist()]
    factors = textops.constants(WALKS * SAMPLES * PLACES, 131).reshape(WALKS, SAMPLES, PLACES) | U(1)
    for walk in range(WALKS):
        y = embed(x, sizes, walk)
        for _, rows, places in kinds:
            sampled = y[rows[:, None, None], places[walk][None]]
            out[rows, walk * SAMPLES : (walk + 1) * SAMPLES] = textops.splitmix((sampled * factors[walk]).sum(axis=2, dtype=U) + U(walk))
    return out


def matched(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Fewest word edits between the item and any stretch of the region, and the first end of such a stretch."""
    idx = np.arange(region.size + 1)
    row = np.zeros(region.size + 1, np.int64)
    for symbol in item:
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (region != symbol))
        row = np.minimum.accumulate(step - idx) + idx
    end = int(row.argmin())
    return int(row[end]), end


def aligned(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits, and begin and end of a stretch of the region that has them."""
    distance, end = matched(item, region)
    _, back = matched(item[::-1], region[:end][::-1])
    return distance, end - back, end


@dataclass
class Size:
    """Items of one length: their words, the tables' keys, and which item each key is of."""

    items: np.ndarray
    numbers: list[int]
    keys: np.ndarray
    owners: np.ndarray


class Index:
    """Items by length, and by their pieces.

    An item of n words may have e = rate * n edits; of its e + 1 disjoint pieces
    of n // (e + 1) words a copy holds one unchanged.  Only item-sized windows
    around such a piece are embedded; no copy within the bound is lost to that.
    Items too short for an edit are one piece: a copy of them is equal.
    """

    def __init__(self, texts: list[bytes], rate: float = EDIT_RATE):
        self.rate = rate
        tables = textops.Tables()
        hashes, first, _, _ = textops.words(texts, tables, lower=True) if texts else (np.zeros(0, U), np.zeros(1, int), None, None)
        self.items = [hashes[p:q] for p, q in zip(first[:-1], first[1:], strict=True)]
        self.sizes: dict[int, Size] = {}
        self.pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        by_size: dict[int, list[int]] = {}
        for i, h in enumerate(self.items):
            if h.size:
                by_size.setdefault(h.size, []).append(i)
        for n, numbers in by_size.items():
            x = np.stack([self.items[i] for i in numbers])
            self.sizes[n] = Size(x, numbers, *self.sorted_keys(keys(x, np.full(len(x), n))))
            width = n // (self.edits(n) + 1)
            places = self.pieces.setdefault(width, {})
            for row in x:
                for p in range(self.edits(n) + 1):
                    at = p * width
                    found = places.setdefault(int(textops.windows(row[at : at + width], width, 37)[0]), [])
                    if (n, at) not in found:
                        found.append((n, at))
        self.sought = {w: np.sort(np.fromiter(p, U, len(p))) for w, p in self.pieces.items()}
        self.filters = {}
        for w, s in self.sought.items():
            self.filters[w] = bits = np.zeros(1 << 20, bool)
            bits[(s >> U(44)).astype(np.int64)] = True

    def edits(self, n: int) -> int:
        return int(self.rate * n)

    @staticmethod
    def sorted_keys(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = k.ravel()
        order = np.argsort(flat, kind="stable")
        return flat[order], order // k.shape[1]

    def seeds(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(place, size, place in the item) of pieces in a run of texts."""
        out = []
        for w, bits in self.filters.items():
            h = textops.windows(hashes, w, 37)
            near = np.flatnonzero(bits[(h >> U(44)).astype(np.int64)])
            near = near[np.isin(h[near], self.sought[w])]
            for p in near.tolist():
                out += [(p, n, at) for n, at in self.pieces[w][int(h[p])]]
        return out

    def candidates(self, texts: list[np.ndarray], places: list[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
        """(text, item, window's begin) with a key in common, of the windows (size, text, begin)."""
        found = set()
        for cut in range(0, len(places), 4096):
            part = places[cut : cut + 4096]
            sizes = np.array([n for n, _, _ in part])
            x = np.zeros((len(part), int(sizes.max())), U)
            for r, (n, i, b) in enumerate(part):
                words = texts[i][b : b + n]
                x[r, : words.size] = words
            k = keys(x, sizes)
            for n in np.unique(sizes).tolist():
                size, rows = self.sizes[n], np.flatnonzero(sizes == n)
                low, high = np.searchsorted(size.keys, k[rows], "left"), np.searchsorted(size.keys, k[rows], "right")
                for r, t in zip(*np.nonzero(high > low), strict=True):
                    _, i, begin = part[rows[r]]
                    found.update((i, size.numbers[o], begin) for o in size.owners[low[r, t] : high[r, t]])
        return found

    def leaks(self, texts: list[np.ndarray], seeds: list[list[tuple[int, int, int]]]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Per text and item: fewest edits, begin and end of its best copy; of equal ones the first."""
        places = sorted({(n, i, max(0, p - at)) for i, own in enumerate(seeds) for p, n, at in own})
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i, number, begin in sorted(self.candidates(texts, places)):
            item = self.items[number]
            e = self.edits(item.size)
            low = max(0, begin - e)
            distance, a, b = aligned(item, texts[i][low : begin + item.size + e])
            if distance <= e:
                best[i, number] = min(best.get((i, number), (distance, low + a, low + b)), (distance, low + a, low + b))
        return best


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[bytes]]]:
    """Items in blocks of about BLOCK_BYTES, one after the other."""
    items = benchmark.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw"))
    size = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("raw", "id"), F.lit(n)) == k).orderBy("id").collect()  # about BLOCK_BYTES
        yield [r[0] for r in rows], [bytes(r[1]) for r in rows]


def scan(raw: list[bytes], index: Index, tables: textops.Tables) -> list[tuple[tuple[int, int], tuple[int, int, int]]]:
    """((text, item), (fewest edits, begin, end)) of a batch."""
    at, texts, seeds = [], [], []
    for lo, hi in textops.steps(raw):
        hashes, first, _, _ = textops.words(raw[lo:hi], tables, lower=True)
        own: dict[int, list] = {}
        for p, n, place in index.seeds(hashes):
            i = int(np.searchsorted(first, p, "right")) - 1
            own.setdefault(i, []).append((p - int(first[i]), n, place))
        for i, s in own.items():
            at.append(lo + i)
            texts.append(hashes[first[i] : first[i + 1]].copy())
            seeds.append(s)
    return [((at[i], item), span) for (i, item), span in sorted(index.leaks(texts, seeds).items())]


def contaminated(df: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and each item of which it holds a copy: doc_id, item_id, begin, end (words), n_edits.

    A copy is a stretch of words, A-Z lower-cased, within rate * n word edits of
    the item's n.  Documents are scanned once for each block of items, so the
    memory for items is bounded; no document leaves its task.

    Null and empty texts hold nothing.  Null ids of documents or items are
    returned as they are.  Null items and items without words aren't looked for,
    short ones are, so a benchmark of single words marks every text that holds
    one; equal items are each reported.  Of several copies of an
    item the one with the fewest edits is reported, then the first.  Repeated
    rows are each reported.  Empty tables give an empty result.  Further columns
    aren't read.
    """
    common.need(benchmark, item_col, item_text_col)
    raw = common.ids_and_text(df, id_col, text_col).where(F.length("text") > 0).select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    kind, item_kind = raw.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for block in blocks(benchmark, item_col, item_text_col):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            names, items = sent.value
            index, tables = Index(items, rate), textops.Tables()
            for b in batches:
                found = scan(b.column("raw").to_pylist(), index, tables)
                distance, begin, end = np.array([span for _, span in found], np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array([i for (i, _), _ in found], pa.int64())), pa.array([names[item] for (_, item), _ in found], item_type),
                        pa.array(begin), pa.array(end), pa.array(distance),
                    ],
                    ["doc_id", "item_id", "begin", "end", "n_edits"],
                )

        part = raw.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, begin long, end long, n_edits long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows whose text holds no copy of an item, all columns kept; null and empty texts stay."""
    common.need(df, "text")
    columns, names = df.columns, [f"c{i}" for i in range(len(df.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema, strict=True))
    out = df.toDF(*names)
    for _, texts in blocks(benchmark, "item_id", "text"):
        sent = df.sparkSession.sparkContext.broadcast(texts)

        def run(batches, sent=sent):
            index, tables = Index(sent.value, rate), textops.Tables()
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[i for (i, _), _ in scan(b.column("raw").to_pylist(), index, tables)]] = False
                yield b.select(names).filter(pa.array(clean, pa.bool_()))

        text = F.coalesce(F.col(names[columns.index("text")]).cast("string"), F.lit(""))
        out = out.withColumn("raw", F.encode(text, "UTF-8")).mapInArrow(run, schema)
    return out.toDF(*columns)


def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
