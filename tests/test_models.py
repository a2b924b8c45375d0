"""What is fitted by iteration or decomposition, against plain computations or separable data."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkoire import storage
from sparkoire.checks import CheckFailed, unique_slugs
from sparkoire.operators import composition as comp
from sparkoire.operators import metrics, models
from sparkoire.plans import learning, measures
from sparkoire.plans.roles import V_GENES, rows
from sparkoire.sources import sequences, tables

SF = "/root/testdata/sf0.001"


def principal(x, train, k):
    """Standardised by the training rows, projected on the leading eigenvectors of their covariance."""
    mean, deviation = train.mean(axis=0), train.std(axis=0, ddof=1)
    scale = np.divide(1, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    vectors = np.linalg.eigh(np.cov(((train - mean) * scale).T))[1][:, ::-1][:, :k]
    return ((x - mean) * scale) @ vectors


def alike(a, b):
    return np.allclose(np.abs(a), np.abs(b), atol=1e-6)


def test_components_of_frequencies(spark):
    f = comp.frequencies(rows(spark, SF, ["specimen_label", "v_gene"]), ["specimen_label"], ["v_gene"])
    wide = sorted(tuple(r) for r in comp.wide(f, ["specimen_label"], "v_gene", V_GENES, F.sum("frequency")).collect())
    x = np.log1p(np.array([r[1:] for r in wide], float))
    got = {r["specimen_label"]: r["components"] for r in measures.pca_features(spark, SF).collect()}
    assert alike(np.array([got[r[0]] for r in wide]), principal(x, x, 3))


def test_components_of_embeddings(spark):
    e = dict(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    x, train = np.array([e[i] for i in sorted(e)], float), np.array([e[i] for i in sorted(e) if i % 2 == 0], float)
    got = {r[0]: r[1] for r in measures.scaled_embeddings(spark, SF).collect()}
    assert alike(np.array([got[i] for i in sorted(e)]), principal(x, train, 4))


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(1)
    made = [(i, c, [rng.gauss(3 * (c == k), 0.5) for k in ("a", "b", "c")]) for i in range(150) for c in ("a", "b", "c")]
    return spark.createDataFrame(made, "id int, label string, x array<double>")


def test_every_model_tells_classes_apart(spark, separable):
    for classes in (["a", "b"], ["a", "b", "c"]):
        df = separable.where(F.col("label").isin(*classes))
        zoo = models.fit_zoo(df.where("id % 2 = 0"), "x", "label", classes, ["lasso", "ridge", "elasticnet", "rf", "svm", "boosting"])
        for name, predict in zoo.items():
            share = predict(df.where("id % 2 = 1")).agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0]
            assert share > 0.95, name


def test_one_class_against_the_rest_or_the_negative(spark, separable):
    wide = separable.select("id", "label", *[F.get("x", F.lit(i)).alias(f"{c}:x") for i, c in enumerate("abc")])
    for contrast in (False, True):
        out = models.one_vs_rest_scores(wide.where("id % 2 = 0"), wide.where("id % 2 = 1"), ["a:x", "b:x", "c:x"], "label", "a", ["a", "b", "c"], contrast)
        assert out.columns == [*wide.columns, "score:b", "score:c"]
        right = out.agg(F.avg(((F.col("label") == "b") == (F.col("`score:b`") > 0.5)).cast("double"))).first()[0]
        assert right > 0.95


def test_path_from_strong_to_weak(spark, separable):
    df = separable.where("label != 'c'").withColumn("target", (F.col("label") == "b").cast("int"))
    path = models.elastic_path(df, "x", "target", [0.01, 10.0, 0.1])
    assert list(path) == [10.0, 0.1, 0.01]
    spread = [p(df).agg(F.stddev("score")).first()[0] for p in path.values()]
    assert spread[0] < 1e-6 < spread[1] < spread[2]


def test_models_of_queries(spark):
    assert learning.model_zoo(spark, SF).groupBy("model").count().count() == 6
    assert learning.one_vs_rest_models(spark, SF).where("`score:c1` between 0 and 1").count() == 250


def test_permutations_find_what_is_planted(spark):
    rng = random.Random(2)
    made = [(g, i, rng.random() + (0.5 if g == "planted" and i % 5 == 0 else 0)) for g in ("planted", "none") for i in range(100)]
    df = spark.createDataFrame(made, "g string, id int, score double")
    got = {r["g"]: r["p"] for r in metrics.precision_permutation(df, "score", F.col("id") % 5 == 0, ["g"], ["id"], rounds=100).collect()}
    assert got["planted"] < 0.02 < got["none"]


def test_records_across_blocks(spark, tmp_path):
    """A file read in many blocks gives each record once, whatever its quality line begins with."""
    rng = random.Random(3)
    made = [(f"r{i} x", "".join(rng.choice("ACGT") for _ in range(rng.randint(2, 60)))) for i in range(400)]
    quality = {n: "".join(rng.choice("@+>IF") for _ in s) + "I" for n, s in made}
    (tmp_path / "a.fastq").write_text("".join(f"@{n}\n{s}\n+\n{quality[n]}\n" for n, s in made))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        read = sequences.fastq(spark, str(tmp_path / "a.fastq"))
        assert sorted((r["name"], r["sequence"], r["quality"]) for r in read.collect()) == sorted((n, s, quality[n]) for n, s in made)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_count_columns(spark):
    df = spark.createDataFrame([(None, 2, 3), (1, 2, 3)], "templates int, seq_reads int, duplicate_count int")
    assert [r["num_reads"] for r in tables.with_counts(df, True).collect()] == [2, 2]
    with pytest.raises(CheckFailed):
        tables.with_counts(df, False)
    assert [r["num_reads"] for r in tables.with_counts(df.select("duplicate_count"), False).collect()] == [1, 1]


def test_file_names_are_unique(spark):
    with pytest.raises(CheckFailed):
        unique_slugs(spark.createDataFrame([("A b",), ("a-B",)], "label string"), "label")


def test_tables_need_a_shared_folder(spark):
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        storage.shared_folder(SimpleNamespace(sparkContext=context))


def test_tables_are_deleted(spark):
    scratch = storage.Scratch(spark, "probe")
    kept = scratch.cut(spark.range(3))
    assert kept.count() == 3
    storage.delete(spark, scratch.root)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch.root)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
