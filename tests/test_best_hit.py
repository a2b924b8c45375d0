import random

import pytest

from sparkoire.operators import legacy
from sparkoire.plans import tables

SF = "/root/testdata/sf0.001"


def plain(queries, references, k):
    def sets(rows):
        out = {}
        for i, s in rows:
            out.setdefault(i, set()).update(s[j : j + k] for j in range(len(s or "") - k + 1))
        return {i: m for i, m in out.items() if m and i is not None}

    q, r = sets(queries), sets(references)
    hits = {i: min(((-len(m & n), j) for j, n in r.items() if m & n), default=None) for i, m in q.items()}
    return sorted((i, h[1], -h[0]) for i, h in hits.items() if h)


def best(spark, queries, references, k):
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, sequence string").repartition(3)
    return sorted(map(tuple, legacy.kmer_best_hit(frame(queries, "query_id"), frame(references, "ref_id"), k).collect()))


@pytest.mark.parametrize("small", [100_000, 0])
def test_best_hit_of_equal_larger_and_other_sets(spark, monkeypatch, small):
    monkeypatch.setattr(legacy, "SMALL", small)
    queries = [(1, "ACGTAC"), (2, "ACGT"), (3, "TTTT"), (4, "GGGA"), (5, "AC"), (6, None), (7, "CCCCCA"), (8, "ACGTAC"), (None, "ACGT"), (9, "TGCATT")]
    references = [(30, "ACGTAC"), (20, "ACGTACGT"), (10, "CACGTACC"), (40, "ACGT"), (9, "TTT"), (8, "TTTT"), (50, "GGGT"), (45, "GGG"), (60, "CCCCA"), (70, "CCC"), (None, "GGGA"), (80, ""), (81, None)]
    assert best(spark, queries, references, 3) == plain(queries, references, 3)
    assert best(spark, queries, [], 3) == [] == best(spark, [], references, 3)


def test_sequences_of_one_id_are_one_set(spark):
    queries, references = [(1, "ACGT"), (1, "ACGT"), (1, "GGGG"), (2, "ACGT")], [(5, "ACGTGGGG"), (6, "ACGT"), (6, "ACGT"), (6, "GGGG"), (4, "TACGT")]
    assert best(spark, queries, references, 3) == plain(queries, references, 3) == [(1, 5, 3), (2, 4, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_best_hit_of_random_sequences(spark, seed):
    draw = random.Random(seed)
    rows = lambda n, longest: [(draw.randrange(n), "".join(draw.choices("ACG", k=draw.randrange(longest)))) for _ in range(n)]
    queries, references = rows(150, 12), rows(150, 24)
    assert best(spark, queries, references + queries[:40], 4) == plain(queries, references + queries[:40], 4)


def test_copies_are_compared_once(spark):
    """Before, 3,000 copies made 9 million pairs for each k-mer."""
    copies = spark.range(3000).selectExpr("id AS query_id", "'ACGTTGCAACGGTA' AS sequence")
    hits = legacy.kmer_best_hit(copies, copies.withColumnRenamed("query_id", "ref_id"))
    assert [tuple(r) for r in hits.groupBy("ref_id", "shared").count().collect()] == [(0, 7, 3000)]


def test_no_table_of_kmers_is_broadcast(spark):
    plan = tables.kmer_best_hit(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
