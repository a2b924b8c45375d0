from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkoire.plans import tables
from sparkoire.plans.roles import rows

SF = "/root/testdata/sf0.001"


def test_all_pairs_of_a_length(spark):
    by = defaultdict(list)
    for (s,) in rows(spark, SF, ["cdr3_seq_aa_q_trim"]).select("cdr3_seq_aa_q_trim").distinct().collect():
        if s is not None:
            by[len(s)].append(s)
    expected = {(a, b): sum(x != y for x, y in zip(a, b, strict=True)) for group in by.values() for a in group for b in group if a < b}
    assert {(r["a"], r["b"]): r["distance"] for r in tables.hamming_pairs(spark, SF).collect()} == expected


def test_mutations_at_all_places(spark):
    germ = F.translate(F.md5((F.col("p_partkey") % 50).cast("string")), "0123456789abcdef", "ACGTACGTACGTAC-.")
    mutated, compared = Counter(), Counter()
    for kind, s, g in spark.read.parquet(f"{SF}/part.parquet").select("p_type", tables.dna(), germ).collect():
        for at, (x, y) in enumerate(zip(s, g, strict=True)):
            if y in "ACGT":
                compared[kind, at] += 1
                mutated[kind, at] += x != y
    got = {(r["p_type"], r["at"]): (r["mutated"], r["compared"]) for r in tables.mutation_track(spark, SF).collect()}
    assert got == {k: (mutated[k], n) for k, n in compared.items()} and max(at for _, at in got) == 31
