"""Split models, one-vs-rest wrappers, scaling and projections, pluggable encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import sequence as seq
from ..functions import vocab

SPLITS: dict[str, Callable[[], list[Column]]] = {
    "v_j": lambda: [F.col("v_gene"), F.col("j_gene")],
    "v": lambda: [F.col("v_gene")],
    "v_isotype": lambda: [F.col("v_gene"), F.col("isotype_supergroup")],
    "family_isotype": lambda: [seq.v_family("v_gene").alias("v_family"), F.col("isotype_supergroup")],
}


def projection(train: DataFrame, columns: list[str], k: int) -> PipelineModel:
    """log1p, standardised, principal components; fitted on the training rows alone."""
    logged = [F.log1p(F.col(f"`{c}`").cast("double")).alias(f"_l{i}") for i, c in enumerate(columns)]
    steps = [VectorAssembler(inputCols=[f"_l{i}" for i in range(len(columns))], outputCol="_v"), StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_z"), PCA(k=k, inputCol="_z", outputCol="components")]
    return Pipeline(stages=steps).fit(train.select("*", *logged))


def project(model: PipelineModel, df: DataFrame, columns: list[str]) -> DataFrame:
    logged = [F.log1p(F.col(f"`{c}`").cast("double")).alias(f"_l{i}") for i, c in enumerate(columns)]
    out = model.transform(df.select("*", *logged))
    return out.select(*df.columns, vector_to_array("components").alias("components"))


def standardisation(train: DataFrame, column: str) -> PipelineModel:
    """Means and sample standard deviations of the training rows' vectors, as a model that can be stored."""
    return Pipeline(stages=[StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_z")]).fit(train.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("_v")))


def standardised(model: PipelineModel, df: DataFrame, column: str) -> DataFrame:
    """Rows with the vector standardised."""
    out = model.transform(df.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double")))))
    return out.withColumn(column, vector_to_array("_z")).select(*df.columns)


def scaled_embeddings(train: DataFrame, other: DataFrame, column: str, k: int) -> DataFrame:
    """Embeddings standardised and projected by what the training rows show; the raw column stays."""
    steps = [StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_z"), PCA(k=k, inputCol="_z", outputCol="_p")]
    vector = array_to_vector(F.transform(column, lambda x: x.cast("double")))
    model = Pipeline(stages=steps).fit(train.withColumn("_v", vector))
    return model.transform(other.withColumn("_v", vector)).select(*other.columns, vector_to_array("_p").alias(f"{column}_scaled"))


def centroid_fit(x: np.ndarray, y: np.ndarray, classes: list[str]) -> dict[str, np.ndarray]:
    return {c: x[y == c].mean(axis=0) for c in classes if (y == c).any()}


def centroid_predict(model: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    distance = {c: ((x - m) ** 2).sum(axis=1) for c, m in model.items()}
    low = np.min(list(distance.values()), axis=0)
    weight = {c: np.exp(-(d - low)) for c, d in distance.items()}
    total = sum(weight.values())
    return {c: w / total for c, w in weight.items()}


def split_scores(train: DataFrame, rows: DataFrame, split: list[str], vector: str, label: str, classes: list[str], ids: list[str], fit=centroid_fit, predict=centroid_predict) -> DataFrame:
    """Class scores of each row by the model of its split; null where the split had no training rows, 0 for classes that it lacked.

    A model is fitted and applied where its split's rows are; the two tables meet by cogroup.
    """
    # Columns of their own: where both tables come from one, Spark mixes up the cogrouped sides' columns.
    scored = rows.select(*[F.col(c).alias(c) for c in (*ids, *[c for c in split if c not in ids], vector)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.drop(vector).schema) + ", " + ", ".join(f"`{c}` double" for c in classes)
    names = [f for f in scored.columns if f != vector]
    empty = pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in scored.drop(vector).schema} | {c: pa.array([], pa.float64()) for c in classes})

    def run(known: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows:
            return empty
        x = np.array(new.column(vector).to_pylist(), float).reshape(new.num_rows, -1)
        out = dict.fromkeys(classes, pa.nulls(new.num_rows, pa.float64()))
        if known.num_rows:
            model = fit(np.array(known.column(vector).to_pylist(), float), np.array(known.column(label).to_pylist()), classes)
            p = predict(model, x)
            out = {c: pa.array(p.get(c, np.zeros(new.num_rows))) for c in classes}
        return pa.table([*[new.column(n) for n in names], *out.values()], names=[*names, *classes])

    return train.select(*split, vector, label).groupBy(*split).cogroup(scored.groupBy(*split)).applyInArrow(run, schema)


def model(name: str, **options):
    """An estimator of the model zoo by name.  ``svm`` and ``boosting`` tell two classes apart; `fit_zoo` wraps them for more."""
    zoo = {
        "lasso": lambda: LogisticRegression(elasticNetParam=1.0, regParam=0.01, **options), "ridge": lambda: LogisticRegression(elasticNetParam=0.0, regParam=0.01, **options),
        "elasticnet": lambda: LogisticRegression(elasticNetParam=0.5, regParam=0.01, **options), "rf": lambda: RandomForestClassifier(seed=0, **options),
        "svm": lambda: LinearSVC(**options), "boosting": lambda: GBTClassifier(seed=0, maxIter=10, **options),
    }
    return zoo[name]()


def feature_vectors(df: DataFrame, vector: str, categories: dict[str, list[str]] | None = None, numbers: list[str] = (), name: str = "features") -> DataFrame:
    """The vector with one-hot columns of fixed vocabularies and numbers behind it; an unknown category raises, a missing one is all zeros."""
    hot = [c for column, values in (categories or {}).items() for c in vocab.one_hot(column, values, "")]
    extra = [F.col(n).cast("double") for n in numbers]
    parts = [F.transform(vector, lambda x: x.cast("double")), *([F.array(*hot, *extra)] if hot or extra else [])]
    return df.withColumn(name, F.concat(*parts))


def dummy_scores(train: DataFrame, rows: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """Rows with each class's share of the training rows as its score, and the most frequent class (of equal ones the first) as ``predicted``."""
    counts = train.groupBy(label).agg(F.count("*").alias("n")).collect()  # a row for each class
    n = {r[0]: r[1] for r in counts}
    total = sum(n.get(c, 0) for c in classes) or 1
    shares = {c: F.lit(n.get(c, 0) / total) for c in classes}
    return rows.withColumns(shares).withColumn("predicted", F.lit(max(classes, key=lambda c: n.get(c, 0))))


def fit_zoo(train: DataFrame, vector: str, label: str, classes: list[str], names: list[str]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """For each name a function that adds ``predicted`` to rows with the vector; training rows are prepared and cached once."""
    place = {c: float(i) for i, c in enumerate(classes)}
    as_vector = lambda df: df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    ready = as_vector(train).select("_v", vocab.mapped(label, {c: str(i) for c, i in place.items()}, pass_through=False).cast("double").alias("_y")).where("_y IS NOT NULL").cache()
    fitted = {}
    for n in names:
        estimator = model(n, featuresCol="_v", labelCol="_y", predictionCol="_p")
        if n in ("svm", "boosting") and len(classes) > 2:
            estimator = OneVsRest(classifier=estimator, featuresCol="_v", labelCol="_y", predictionCol="_p")
        fitted[n] = estimator.fit(ready)
    ready.unpersist()
    names_of = F.array(*map(F.lit, classes))

    def predictor(m):
        return lambda rows: m.transform(as_vector(rows)).select(*rows.columns, F.get(names_of, F.col("_p").cast("int")).alias("predicted"))

    return {n: predictor(m) for n, m in fitted.items()}


def elastic_path(train: DataFrame, vector: str, target: str, strengths: list[float], mixing: float = 0.5) -> dict[float, Callable[[DataFrame], DataFrame]]:
    """For each regularisation strength, strongest first, a function that adds ``score``, the probability of target 1."""
    ready = train.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).select("_v", F.col(target).cast("double").alias("_y")).cache()
    base = LogisticRegression(elasticNetParam=mixing, featuresCol="_v", labelCol="_y")
    fitted = {s: base.copy({base.regParam: s}).fit(ready) for s in sorted(strengths, reverse=True)}
    ready.unpersist()

    def scorer(m):
        def score(rows):
            out = m.transform(rows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
            return out.select(*rows.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        return score

    return {s: scorer(m) for s, m in fitted.items()}


def one_vs_rest_scores(train: DataFrame, rows: DataFrame, columns: list[str], label: str, negative: str, classes: list[str], contrast: bool = False, name: str = "ridge") -> DataFrame:
    """Rows with a score for each class but the negative one, by a binary model on that class's own columns.

    The class stands against all others, or with ``contrast`` against the negative class alone; scores aren't normalised.
    """
    tables = (one_vs_negative_labels if contrast else one_vs_rest_labels)(train, label, negative, classes)
    out = rows
    for c, table in tables.items():
        own = class_columns(columns, c) or columns
        vector = F.array(*[F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(0.0)) for x in own])
        fitted = model(name, featuresCol="_v", labelCol="target").fit(table.select(array_to_vector(vector).alias("_v"), F.col("target").cast("double").alias("target")))
        scored = fitted.transform(out.withColumn("_v", array_to_vector(vector)))
        out = scored.select(*out.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(f"score:{c}"))
    return out


def one_vs_rest_labels(df: DataFrame, label: str, negative: str, classes: list[str]) -> dict[str, DataFrame]:
    """Training rows of each class but the negative one: the class against all others."""
    return {c: df.withColumn("target", (F.col(label) == c).cast("int")) for c in classes if c != negative}


def one_vs_negative_labels(df: DataFrame, label: str, negative: str, classes: list[str]) -> dict[str, DataFrame]:
    """The class against the negative class alone."""
    return {c: df.where(F.col(label).isin(c, negative)).withColumn("target", (F.col(label) == c).cast("int")) for c in classes if c != negative}


def class_columns(columns: list[str], cls: str) -> list[str]:
    """Features named after a class."""
    return [c for c in columns if c.split("|")[0] == cls or c.startswith(f"{cls}:")]


def best_threshold(scores: DataFrame, candidates: list[float], metric: Callable[[DataFrame, float], float]) -> float:
    """The candidate with the highest metric; of equal ones the first.  Inputs are read once for each candidate, so cache them."""
    return max(candidates, key=lambda t: (metric(scores, t), -candidates.index(t)))


# Region contents: which columns are joined, and which of them is pooled.
CONTENTS = {
    "cdr3": (("cdr3_seq_aa_q_trim",), "cdr3_seq_aa_q_trim"),
    "cdr1_cdr2_cdr3": (("cdr1_seq_aa_q_trim", "cdr2_seq_aa_q_trim", "cdr3_seq_aa_q_trim"), None),
    "fr1_to_fr4": (tuple(f"{r}_seq_aa_q_trim" for r in ("fr1", "cdr1", "fr2", "cdr2", "fr3", "cdr3", "post")), None),
    "fr1_to_fr4_pooled_on_cdr3": (tuple(f"{r}_seq_aa_q_trim" for r in ("fr1", "cdr1", "fr2", "cdr2", "fr3", "cdr3", "post")), "cdr3_seq_aa_q_trim"),
}


def regions(df: DataFrame, content: str) -> DataFrame:
    """``text``, ``slice_start`` (zero-based) and ``slice_end``; a null or blank region raises."""
    columns, pooled = CONTENTS[content]
    checked = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.raise_error(F.lit(f"blank {c}")).cast("string")).otherwise(F.col(c)) for c in columns]
    text = F.concat(*checked)
    if pooled is None:
        return df.withColumn("text", text).withColumn("slice_start", F.lit(0)).withColumn("slice_end", F.length("text"))
    start = sum((F.length(c) for c in columns[: columns.index(pooled)]), F.lit(0))
    return df.withColumn("text", text).withColumn("slice_start", start).withColumn("slice_end", F.col("slice_start") + F.length(pooled))


def residue_encoder(texts: list[str], starts: list[int], ends: list[int]) -> list[list[float]]:
    """Stands in where no weights are at hand: shares of the residues within the slice."""
    return [[t[a:b].count(r) / max(1, b - a) for r in seq.AMINO_ACIDS] for t, a, b in zip(texts, starts, ends, strict=True)]


ENCODERS: dict[str, Callable] = {"residues": residue_encoder}


def encode(df: DataFrame, encoder: str = "residues", ids: list[str] = ("doc_id",), batch: int = 1024) -> DataFrame:
    """ids and ``embedding`` of rows with text, slice_start and slice_end, by a registered encoder in batches."""
    run_encoder = ENCODERS[encoder]
    ids = list(ids)

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                values = run_encoder(*(b.column(c).to_pylist() for c in ("text", "slice_start", "slice_end")))
                yield b.select(ids).append_column("embedding", pa.array(values, pa.list_(pa.float32())))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*ids).schema)
    return df.select(*ids, "text", "slice_start", "slice_end").mapInArrow(run, f"{schema}, embedding array<float>")
