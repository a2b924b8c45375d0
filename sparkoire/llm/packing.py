"""Token packing by vector best-fit: tokens, documents and attention cost."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096
#: Words that a worker remembers; beyond, it forgets them all.
REMEMBERED = 1_000_000
#: Pieces that one task packs at most, about; tasks share no sequence, so each may leave one part empty.
GROUP_PIECES = 8192


def byte_letters() -> dict[int, str]:
    """The tokenizer's letters for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts, word by word, each distinct word once.

    The tokenizer drops white space and no token spans it, so the ids of a text
    are those of its words in order.  Words are cut at space and line feed alone,
    which any rule of white space holds to be some.  Words of Latin letters with
    points and commas behind go to its model straight away: below U+0250, NFC
    changes nothing, lower case is one rule, and its pattern takes the letters as
    one run and the points as another.  All other words go through all its steps.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {"": b""}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.replace("\n", " ").split(" ")
        if len(self.words) > REMEMBERED:
            self.words = {"": b""}
        if missing := set(words).difference(self.words):
            self.learn(missing)
        return b"".join(map(self.words.__getitem__, words))

    def learn(self, missing: set[str]) -> None:
        known, tokenize, letters, odd = self.words, self.tokenizer.model.tokenize, self.letters, []
        for w in missing:
            core = w.rstrip(".,")
            lower = core.lower()
            if not lower.isalpha() or not (core.isascii() or max(core) < "ɐ"):
                odd.append(w)
                continue
            if (ids := known.get(core)) is None:
                spelt = lower if lower.isascii() else lower.encode().decode("latin-1").translate(letters)
                ids = known[core] = array("I", [x.id for x in tokenize(spelt)]).tobytes()
            if w is not core:
                points = w[len(core) :]
                if points not in known:
                    known[points] = self.whole([points])[0]
                known[w] = ids + known[points]
        if odd:
            known.update(zip(odd, self.whole(odd), strict=True))

    def whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


#: Of a worker process, by path; kept from task to task.
_KEPT: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and path."""
    if path not in _KEPT:
        _KEPT[path] = WordTokenizer(path)
    return _KEPT[path]


def pieces(texts: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, END_ID behind them, cut at the capacity."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = worker_tokenizer(tokenizer)
        for b in batches:
            rows, cuts = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = known.ids(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    cuts.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            piece, start, length, crc = np.array(cuts, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int, documents: int, attention: float, weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """Bin of each piece.  Pieces come longest first; a piece goes to the open bin that it suits best, else to a new one.

    A bin has three residual capacities, as shares: tokens, documents, attention
    cost (the sum of squared lengths).  Only bins with room in all three are
    considered.  ``norm`` takes the least weighted norm of what would remain,
    ``dot`` the greatest weighted product of demand and residual; the first on ties.
    """
    demand = np.stack([lengths / capacity, np.full(lengths.size, 1 / documents), lengths.astype(float) ** 2 / attention], axis=1)
    residual, left, used = np.empty((lengths.size, 3)), np.empty(lengths.size, np.int64), 0
    weight = np.array(weights)
    out = np.empty(lengths.size, np.int64)
    open_bins = np.empty(0, np.int64)
    for k, i in enumerate(np.argsort(-lengths, kind="stable")):
        d, n = demand[i], int(lengths[i])
        room = open_bins[(left[open_bins] >= n) & (residual[open_bins, 1] >= d[1] - 1e-12) & (residual[open_bins, 2] >= d[2] - 1e-12)]
        if room.size:
            after = residual[room]
            b = room[(((after - d) ** 2) @ weight).argmin() if rule == "norm" else ((after * d) @ weight).argmax()]
        else:
            b, used = used, used + 1
            residual[b], left[b] = 1.0, capacity
            open_bins = np.append(open_bins, b)
        residual[b] -= d
        left[b] -= n
        out[i] = b
        if not left[b] or k % 512 == 511:
            open_bins = open_bins[(left[open_bins] > 0) & (residual[open_bins, 1] >= 1 / documents - 1e-12)]
    return out


def pack(
    df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, documents: int = CAPACITY, attention: float = float(CAPACITY) ** 2,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each piece of each document: where it is cut and where it is put.

    Documents are tokenized whole, END_ID follows; only documents of more than
    ``capacity`` ids are cut.  Pieces that fill a sequence get one of their own;
    the rest is dealt to groups of about GROUP_PIECES by hash, and each group is
    packed by ``best_fit`` under the capacities of tokens, documents (pieces in a
    sequence) and attention cost.  The defaults of the latter two never bind.
    ``sequence_id`` is unique over groups; offsets run without gaps from 0.

    Null and empty texts are one piece of END_ID.  Null ids are packed like
    others.  Repeated rows are each packed.  An empty table gives an empty
    result.  Further columns aren't read.
    """
    if attention < float(capacity) ** 2 or documents < 1:
        raise ValueError("a full piece must fit into an empty sequence")
    spark = df.sparkSession
    scratch = common.Scratch(spark, "packing")
    cut = pieces(common.ids_and_text(df, id_col, text_col), tokenizer or public_tokenizers.path(TOKENIZER), capacity)
    cut = scratch.cut(cut.withColumn("at", F.monotonically_increasing_id()))
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    shift = (2 * GROUP_PIECES - 1).bit_length() + 8

    def fit(key, table):
        group = key[0].as_py()
        table = table.sort_by("at")
        lengths = table.column("length").to_numpy()
        bins = best_fit(lengths, capacity, documents, attention, weights, rule)
        order = np.lexsort((np.arange(bins.size), bins))
        ends = np.cumsum(lengths[order])
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        starts = ends - lengths[order]
        offsets = np.empty(bins.size, np.int64)
        offsets[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        return table.select(names).append_column("sequence_id", pa.array((group << shift) + bins)).append_column("offset", pa.array(offsets))

    kind = cut.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = rest.withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups))).groupBy("group").applyInArrow(fit, schema)
    full = cut.where(F.col("length") == capacity).select(*names, (-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(full)


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
