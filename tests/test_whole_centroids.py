from collections import defaultdict

import pytest

from sparkoire.plans import sequences

SF = "/root/testdata/sf0.001"


def test_nearest_of_all_centroids(spark):
    by = defaultdict(list)
    for r in sequences.cluster_consensus(spark, SF).collect():
        by[r["v_gene"], r["j_gene"], len(r["consensus"])].append((r["consensus"], r["cluster"]))
    got = sequences.nearest_centroid(spark, SF).collect()
    assert any(r["nearest"] >= "K" for r in got)
    for r in got:
        s = r["cdr3_seq_aa_q_trim"]
        distance, nearest = min((sum(x != y for x, y in zip(s, c, strict=True)) / len(s), name) for c, name in by[r["v_gene"], r["j_gene"], len(s)])
        assert r["nearest"] == nearest and r["distance"] == pytest.approx(distance, abs=1e-8)
