from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkoire.operators import vectors
from sparkoire.plans import measures

SF = "/root/testdata/sf0.01"


def test_neighbourhood_follows_batches(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    sizes = Counter(r[0] for r in e.select("label").collect())
    n = sum(sizes.values())
    k = min(50, max(10, n // len(sizes) // 4))
    assert k > 10
    around = {i: Counter() for (i,) in e.select("vec_id").collect()}
    for r in measures.kbet_counts(spark, SF).collect():
        around[r["center_id"]][r["neighbor_label"]] += r["n"]
    assert {sum(c.values()) for c in around.values()} == {k}
    for r in measures.kbet_chi_square(spark, SF).collect():
        expected = sum((around[r["center_id"]][b] - k * m / n) ** 2 / (k * m / n) for b, m in sizes.items())
        assert r["chi_square"] == pytest.approx(expected, abs=1e-5)


def test_each_label_has_its_own_run(spark):
    made = [("mixed", i % 2, float(i)) for i in range(120)] + [("apart", i // 60, float(i)) for i in range(120)] + [("alone", 0, 0.0)]
    df = spark.createDataFrame([(n, label, batch, [x, 0.0]) for n, (label, batch, x) in enumerate(made)], "vec_id long, identity string, batch int, embedding array<double>")
    got = {r["label"]: (r["k"], r["rejection_rate"]) for r in vectors.rejection_rates(df, "batch", "identity").collect()}
    assert set(got) == {"mixed", "apart"} and got["mixed"] == (15, 0.0) and got["apart"][0] == 15 and got["apart"][1] > 0.8
