"""Document quality by regularised quadratic discriminant analysis."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What `statistics` returns, in order.
STATISTICS = ("mean_word", "upper", "digits", "symbols", "points", "types", "stutter", "short_words")
#: Words, or bytes of words, of ordinary text that are added to every text, so that a few words don't look extreme.
PRIOR_WORDS, PRIOR_BYTES = 20, 100
SYMBOLS = b"#$%&*|@^~=+<>{}[]\\/_`!"
POINTS = b".,;:'\"?()-"


def statistics(raw: bytes, kinds: np.ndarray) -> list[float]:
    """Transformed statistics of a text: square roots of smoothed shares, and logs.  No sizes and no alphabet are among them."""
    words = raw.split()
    count = np.bincount(kinds[np.frombuffer(raw, np.uint8)], minlength=6)
    filled = PRIOR_BYTES + len(raw) - int(count[5])
    n = len(words) + PRIOR_WORDS
    return [
        np.log(filled / n), (count[1] / filled) ** 0.5, (count[2] / filled) ** 0.5, (count[3] / filled) ** 0.5, (count[4] / filled) ** 0.5,
        np.log(len(set(words)) + PRIOR_WORDS) / np.log(n),
        (sum(map(eq, words, words[1:])) / n) ** 0.5, ((sum(len(x) <= 3 for x in words) + PRIOR_WORDS / 4) / n) ** 0.5,
    ]


def byte_kinds() -> np.ndarray:
    """0 other bytes, 1 capitals, 2 digits, 3 symbols, 4 points, 5 white space."""
    kinds = np.zeros(256, np.int64)
    kinds[65:91], kinds[48:58], kinds[list(b" \t\n\v\f\r")] = 1, 2, 5
    kinds[list(SYMBOLS)], kinds[list(POINTS)] = 3, 4
    return kinds


@dataclass
class Model:
    """Means, inverse Cholesky factors and log-densities' constants of classes 0 and 1, in standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    constant: float | None

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1): the logistic of the difference of Mahalanobis log-densities and log priors."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        logs = [self.offsets[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float) -> Model:
    """From each class's count, sums and sums of products; covariances are shrunk towards their mean variance.

    Without rows of both classes the score is the share of label 1, without any 0.5.
    """
    d = len(STATISTICS)
    zero = (0.0, np.zeros(d), np.zeros((d, d)))
    counts, sums, products = zip(*(moments.get(c, zero) for c in (0, 1)))
    n = sum(counts)
    if min(counts) < 1:
        return Model(np.zeros(d), np.ones(d), np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), counts[1] / n if n else 0.5)
    centre = sum(sums) / n
    spread = np.sqrt(np.maximum(np.diag(sum(products)) / n - centre**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means, factors, offsets = [], [], []
    for c in (0, 1):
        mean = sums[c] / counts[c]
        cov = (products[c] / counts[c] - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(counts[c] / n) - np.log(np.diag(lower)).sum())
    return Model(centre, scale, np.array(means), np.array(factors), np.array(offsets), None)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def describe(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Statistics beside the other columns."""
    keep = [c for c in df.columns if c != text_col]

    def run(batches):
        kinds = byte_kinds()
        for b in batches:
            values = [statistics(t or b"", kinds) for t in b.column(text_col).to_pylist()]
            yield b.select(keep).append_column(out_col, pa.array(values, pa.list_(pa.float64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    return df.mapInArrow(run, f"{schema}, `{out_col}` array<double>")


def train(described: DataFrame, labels: DataFrame, shrinkage: float) -> Model:
    """From all labelled rows that aren't held out; each task adds up its rows, Spark adds up the tasks."""
    d = len(STATISTICS)
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1)).distinct()
    rows = described.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("quality", "x")

    def run(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, d)
            y = b.column("quality").to_numpy()
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["c", "v"])

    parts = rows.mapInArrow(run, "c int, v array<double>").select("c", F.posexplode("v").alias("at", "v")).groupBy("c", "at").agg(F.sum("v").alias("v"))
    found = np.zeros((2, 1 + d + d * d))
    for c, at, v in parts.collect():  # two classes, 1 + d + d * d sums
        found[c, at] = v
    return fit({c: (found[c, 0], found[c, 1 : 1 + d], found[c, 1 + d :].reshape(d, d)) for c in (0, 1)}, shrinkage)


def classify(df: DataFrame, labels: DataFrame, threshold: float = 0.7, shrinkage: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, label 1 likelier when higher) and predicted of each row.

    Statistics of whole texts alone are scored; labels of rows that aren't held
    out (crc32 of the id as text mod 4 is not 2) train the two classes'
    Gaussians, all of them, by sums that are added up on the executors.

    Null and empty texts have the prior's statistics and are scored like others.  Null
    ids match no label and aren't held out.  Repeated rows are each scored;
    repeated labels count once, contradicting ones once for each class, null and
    other labels not at all.  Without labels of both classes the score is the
    share of label 1, 0.5 without any.  An empty table gives an empty result.
    Further columns aren't read.
    """
    common.need(labels, "doc_id", "quality")
    scratch = common.Scratch(df.sparkSession, "quality")
    raw = common.ids_and_text(df, id_col, text_col).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    described = scratch.cut(describe(raw, "raw", "x"))
    model = train(described, labels, shrinkage)
    kind = raw.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield b.select(["doc_id"]).append_column("score", pa.array(model.score(x), pa.float64()))

    scored = described.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows that `classify` predicts as good, all columns kept."""
    scratch = common.Scratch(df.sparkSession, "quality")
    columns = df.columns
    names = [f"c{i}" for i in range(len(columns))]
    wide = df.toDF(*names).withColumn("raw", F.encode(F.coalesce(F.col(names[columns.index("text")]).cast("string"), F.lit("")), "UTF-8"))
    ids = names[columns.index("doc_id")]
    model = train(scratch.cut(describe(wide.select(F.col(ids).alias("doc_id"), "raw"), "raw", "x")), labels, 0.1)

    def run(batches):
        kinds = byte_kinds()
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t, kinds) for t in b.column("raw").to_pylist()], float)
                yield b.select(names).filter(pa.array(model.score(x) >= threshold))

    kept = wide.mapInArrow(run, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema, strict=True)))
    return kept.toDF(*columns)


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
