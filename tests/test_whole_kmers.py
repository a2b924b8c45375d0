from sparkoire.plans import tables

SF = "/root/testdata/sf0.001"


def test_best_hit_among_all_parts(spark):
    parts = dict(spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", tables.dna()).collect())
    mers = {i: {s[j : j + 8] for j in range(len(s) - 7)} for i, s in parts.items()}
    expected = {i: min((-len(m & n), j) for j, n in mers.items()) for i, m in mers.items()}
    assert {r["query_id"]: (-r["shared"], r["ref_id"]) for r in tables.kmer_best_hit(spark, SF).collect()} == expected
