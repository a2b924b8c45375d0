"""Golden cases, invariants and error paths of the operators."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkoire.checks import CheckFailed, checked_join, checked_loss, require_all, shared_join
from sparkoire.functions import sequence as seq
from sparkoire.functions import stats, vocab
from sparkoire.operators import association, clustering, combine, composition, folds, legacy, metadata, metrics, models, reads, rollup, vectors, windows
from sparkoire.schema import SAMPLED, enforce
from sparkoire.sources import sequences, sinks, tables
from sparkoire.streaming import counts


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [(" a.c-d* ", "ACD"), ("...", None), ("", None), (None, None)])
def test_trim(spark, text, expected):
    assert one(spark, seq.trim_sequence("s"), s=text) == expected


@pytest.mark.parametrize("v, family", [("IGHV1/OR15-1", "IGHV1"), ("TRBV29/OR9-2", "TRBV29"), ("IGHV3-23", "IGHV3"), ("TRBV20", "TRBV20")])
def test_v_family(spark, v, family):
    assert one(spark, seq.v_family("v"), v=v) == family


def test_blank_v_family_raises(spark):
    with pytest.raises(Exception, match="blank V gene"):
        one(spark, seq.v_family("v"), v=" ")


def test_scalars(spark):
    assert one(spark, seq.strip_ends("s"), s="CAW") == "A" and one(spark, seq.strip_ends("s"), s="CW") is None
    assert one(spark, seq.without_prefix("s", "p"), s="ABCD", p="AB") == "CD" and one(spark, seq.without_prefix("s", "p"), s="ABCD", p="X") == "ABCD"
    assert one(spark, seq.mutation_rate("s"), s="aCgT") == 0.5 and one(spark, seq.mutation_rate("s"), s="") is None
    assert one(spark, seq.reverse_complement("s"), s="AACG") == "CGTT"
    assert one(spark, seq.translate_codons("s"), s="ATG---TGGNNNTA") == "MWX"
    assert one(spark, seq.hamming("a", "b"), a="ABCD", b="ABXD") == 1 and one(spark, seq.hamming("a", "b"), a="A", b="AB") is None
    assert one(spark, seq.rightmost_motif("s", ("WG.G",)), s="AWGAGWGCG") == 5 and one(spark, seq.rightmost_motif("s", ("WG.G", "G")), s="AGG") == 2
    assert one(spark, seq.mutation_marks("q", "g"), q="acgt", g="aCtt") == "acGt"
    assert one(spark, seq.insert_gaps("s", "t"), s="ABC", t="x.x.x") == "A.B.C"
    assert one(spark, seq.slug("s"), s=" TRBV6-2*01 / x ") == "trbv6-2-01-x"
    assert one(spark, vocab.day_of("t"), t="Day 12 (visit 3)") == 12 and one(spark, vocab.day_of("t"), t="00:00:00") == 0 and one(spark, vocab.day_of("t"), t="visit 3") is None
    assert one(spark, vocab.isotype_supergroup("t"), t="multi-IGHG") == "IGHG" and one(spark, vocab.isotype_supergroup("t"), t="IGHM") == "IGHD-M"


def test_schema(spark):
    out = enforce(spark.createDataFrame([("p", "7", "x", 1)], "participant_label string, num_reads string, isotype_supergroup string, extra int"), SAMPLED, {"isotype_supergroup": ["IGHG"]})
    assert out.schema.names == SAMPLED.names and out.first()["num_reads"] == 7 and out.first()["isotype_supergroup"] is None
    assert enforce(spark.createDataFrame([], "a int"), SAMPLED).count() == 0


def test_checks(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string"), spark.createDataFrame([(1, "z")], "k int, b string")
    assert checked_join(a, b, ["k"], validate="m:1").count() == 2
    with pytest.raises(CheckFailed):
        checked_join(a, b, ["k"], validate="1:1")
    with pytest.raises(CheckFailed):
        require_all(a, spark.createDataFrame([(2,)], "k int"), "k")
    with pytest.raises(CheckFailed):
        checked_loss(a.limit(0), a, b)
    with pytest.raises(CheckFailed):
        shared_join(spark.createDataFrame([(1, "x")], "k int, d string"), spark.createDataFrame([(1, "y")], "k int, d string"), "k")
    assert shared_join(spark.createDataFrame([(1, None)], "k int, d string"), spark.createDataFrame([(1, None)], "k int, d string"), "k").count() == 1


def test_weights_of_clones(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5)], "s string, n long")
    got = sorted(r["weight"] for r in reads.share(df, "n", ["s"]).collect())
    assert got == pytest.approx([1 / 6, 2 / 6, 3 / 6, 1, 1])


def test_first_wins_by_order(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early")], "k string, o int, v string")
    assert reads.count_reads(df, ["k"], ["o"], ["v"]).first().asDict() == {"k": "k", "num_reads": 2, "v": "early"}


def test_unknown_mutation_rate_stays(spark):
    df = spark.createDataFrame([("IGHD-M", None), ("IGHD-M", 0.0), ("IGHD-M", 0.5), ("IGHG", 0.0)], "isotype_supergroup string, v_mut double")
    assert reads.mutated_or_other(df).count() == 3


def reads_fixture(spark):
    """Three classes of three patients; 25 gene pairs; in each a sequence of the class and a common one."""
    rows = []
    for c in range(3):
        for p in range(3):
            for v in range(5):
                for j in range(5):
                    own = "ACDEFGHIKL"[c] * 4 + "QRST" + "VWYA"[c] * 4
                    rows += [(f"p{c}{p}", f"s{c}{p}", f"c{c}", f"V{v}", f"J{j}", own), (f"p{c}{p}", f"s{c}{p}", f"c{c}", f"V{v}", f"J{j}", "MNPQMNPQMNPQ")]
    return spark.createDataFrame(rows, "participant_label string, specimen_label string, disease string, v_gene string, j_gene string, cdr3 string")


CLASSES, SEQ = ["c0", "c1", "c2"], ["v_gene", "j_gene", "cdr3"]


def test_exact_matches_golden(spark):
    df = reads_fixture(spark)
    scored = association.fisher_right(association.class_counts(df, SEQ, "disease", CLASSES), association.class_totals(df, "disease", CLASSES), CLASSES, SEQ)
    assert scored.count() == 100 and association.below(scored, 0.05, CLASSES).count() == 75
    features, abstained = association.exact_features(df, scored, SEQ, 0.05, CLASSES)
    assert {tuple(sorted(r.asDict().items())) for r in features.select(*CLASSES).distinct().collect()} == {tuple(sorted({c: 500.0 if c == d else 0.0 for c in CLASSES}.items())) for d in CLASSES}
    assert abstained.count() == 0


def test_clusters_golden(spark):
    df = clustering.cluster(reads_fixture(spark), ["v_gene", "j_gene"], "cdr3", 0.85)
    key = ["v_gene", "j_gene", "cluster"]
    assert df.select(*key).distinct().count() == 100
    scored = association.fisher_right(association.class_counts(df, key, "disease", CLASSES), association.class_totals(df, "disease", CLASSES), CLASSES, key)
    assert {r["n"] for r in association.predictive(scored, key, 0.05, CLASSES).collect()} == {25}
    hits, none = association.cluster_features(df.withColumn("key", F.concat_ws("|", *key)), scored.withColumn("key", F.concat_ws("|", *key)), "key", 0.05, CLASSES)
    assert {tuple(sorted((r[c] for c in CLASSES))) for r in hits.collect()} == {(0, 0, 25)} and none.count() == 0


def test_fisher_value(spark):
    p = association.fisher_right(spark.createDataFrame([("x", 24, 2)], "k string, a long, b long"), {"a": 25, "b": 8}, ["a", "b"], ["k"]).first()
    assert p["p_a"] == pytest.approx(0.00016572847, abs=1e-9) and 0 <= p["p_b"] <= 1


def test_identity_threshold_is_in_doubles(spark):
    df = spark.createDataFrame([("v", "AAAAAAAAAA"), ("v", "AAAAAAAAAC")], "v string, s string")
    assert clustering.cluster(df, ["v"], "s", 0.90).select("cluster").distinct().count() == 2
    assert clustering.cluster(df, ["v"], "s", 0.90, clustering.legacy_mismatches).select("cluster").distinct().count() == 1


def naive_clusters(sequences, identity):
    root = {s: s for s in sequences}
    for _ in sequences:
        for a in sequences:
            for b in sequences:
                if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) / len(a) <= 1 - identity:
                    root[a] = root[b] = min(root[a], root[b])
    return root


@settings(max_examples=4, deadline=None)
@given(st.sets(st.text("AC", min_size=6, max_size=7), min_size=2, max_size=9))
def test_clusters_match_naive(spark, sequences):
    df = spark.createDataFrame([("v", s) for s in sequences], "v string, s string")
    got = {r["s"]: r["cluster"] for r in clustering.cluster(df, ["v"], "s", 0.8).collect()}
    assert got == naive_clusters(sorted(sequences), 0.8)


def test_consensus_and_assignment(spark):
    df = spark.createDataFrame([("v", "c", "AAC"), ("v", "c", "AAC"), ("v", "c", "ATC"), ("v", "c", "GTG")], "v string, cluster string, s string")
    made = clustering.consensus(df, ["v", "cluster"], "s")
    assert made.first()["consensus"] == "AAC"
    got = clustering.assign(spark.createDataFrame([("v", "AAG"), ("v", "GGG"), ("w", "AAC")], "v string, s string"), made, ["v"], "s", 0.6)
    assert {r["s"]: (r["assigned"], None if r["distance"] is None else round(r["distance"], 3)) for r in got.collect()} == {"AAG": ("c", 0.333), "GGG": (None, 1.0), "AAC": (None, None)}


def scores(spark):
    return spark.createDataFrame([("s", i, i / 10, 1 - i / 10, 1.0) for i in range(11)], "specimen_label string, i int, a double, b double, weight double")


def test_rollups_are_symmetric(spark):
    df = scores(spark)
    for out in (rollup.weighted_mean(df, ["specimen_label"], ["a", "b"], "weight"), rollup.trimmed(df, ["specimen_label"], ["a", "b"], "weight", 0.1, ["i"]), rollup.medians(df, ["specimen_label"], ["a", "b"], "weight")):
        assert out.first()["a"] == pytest.approx(0.5) and out.first()["b"] == pytest.approx(0.5)
    assert rollup.trimmed(df, ["specimen_label"], ["a"], "weight", 0.1, ["i"], both=False).first()["a"] == pytest.approx(0.55)
    flat = spark.createDataFrame([("s", 0.5, 0.5, 1.0)], "specimen_label string, a double, b double, weight double")
    assert rollup.confident_mean(flat, ["specimen_label"], ["a", "b"], "weight").first()["a"] == 0.5
    assert one(spark, stats.entropy(["a", "b"]), a=0.5, b=0.5) == pytest.approx(math.log(2))


def test_partly_null_scores_raise(spark):
    df = spark.createDataFrame([(0.1, None), (None, None)], "a double, b double")
    with pytest.raises(Exception, match="partly null"):
        rollup.scored_rows(df, ["a", "b"]).collect()


def test_weighted_median_rules(spark):
    df = spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 1), ("h", 1.0, 1), ("h", 2.0, 3)], "g string, x double, w long")
    assert {r["g"]: r["weighted_median"] for r in composition.weighted_median(df, ["g"], "x", "w").collect()} == {"g": 1.5, "h": 2.0}


def test_normalised_rows(spark):
    got = composition.normalised(spark.createDataFrame([("a", 1.0, 3.0), ("b", 0.0, 0.0)], "s string, x double, y double"), ["x", "y"]).collect()
    assert {(r["s"], r["x"], r["y"]) for r in got} == {("a", 0.25, 0.75), ("b", 0.0, 0.0)}


def test_folds(spark):
    people = spark.createDataFrame([(f"p{i}", f"d{i % 3}") for i in range(60)], "participant_label string, disease string")
    out = folds.check_folds(folds.assign_folds(people, "participant_label", "disease"), "participant_label", 3)
    per = {(r["fold_id"], r["fold_label"]): r["n"] for r in out.groupBy("fold_id", "fold_label").agg(F.count("*").alias("n")).collect()}
    assert all(18 <= per[i, "test"] <= 21 for i in range(3)) and (-1, "test") not in per
    assert folds.capped(people, "disease", 5, ["participant_label"]).count() == 15


def test_combination(spark):
    f = lambda *k: spark.createDataFrame([(x, 1.0) for x in k], "specimen_label string, v double")
    m = lambda *k: spark.createDataFrame([(x, "d") for x in k], "specimen_label string, disease string")
    a = lambda *k: spark.createDataFrame([(x,) for x in k], "specimen_label string")
    features, metadata_, abstained = combine.combine({"one": (f("a", "b"), m("a", "b", "c"), a("c")), "two": (f("a", "c"), m("a", "b", "c"), a("b"))})
    assert [r["specimen_label"] for r in features.collect()] == ["a"] and metadata_.count() == 3 and {r[0] for r in abstained.collect()} == {"b", "c"}
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, i < 5) for i in range(9)], "c double, y double, train boolean")
    assert max(abs(r["y"]) for r in combine.residuals(df, ["y"], ["c"], "train").collect()) < 1e-9


def test_one_hot(spark):
    df = spark.createDataFrame([("F",), (None,)], "sex string")
    assert [tuple(r) for r in df.select(*vocab.one_hot("sex", ["M", "F"], "sex_")).collect()] == [(0.0, 1.0), (0.0, 0.0)]
    with pytest.raises(Exception, match="unknown category"):
        spark.createDataFrame([("X",)], "sex string").select(*vocab.one_hot("sex", ["M", "F"], "sex_")).collect()


def test_metadata_rules(spark):
    ages = metadata.age_groups(spark.createDataFrame([(17,), (20,), (79,), (80,), (100,)], "age int")).collect()
    assert [r["age_group"] for r in ages] == ["0-20", "20-30", "70-80", None, None] and ages[0]["age_group_pediatric"] == "under 18"
    df = spark.createDataFrame([("p", 3), ("p", 14), ("p", 16), ("p", 90)], "p string, day int")
    assert windows.closest(df, ["p"], "day", 15, 7, 40, ["day"]).first()["day"] == 14


def test_metrics(spark):
    df = spark.createDataFrame([("g", x, x > 2) for x in (1.0, 2.0, 2.0, 3.0, 4.0)], "g string, x double, p boolean")
    got = metrics.mann_whitney(df, "x", F.col("p"), ["g"]).first()
    assert got["u"] == 6 and got["auroc"] == 1.0
    for z in (0.0, 1.0, 2.5, 5.0, -1.5):
        assert one(spark, metrics.normal_tail(F.col("z")), z=z) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-6)
    for df_, x, p in ((1, 3.841459, 0.05), (2, 5.991465, 0.05), (5, 11.0705, 0.05), (9, 16.91898, 0.05)):
        assert one(spark, metrics.chi_square_tail(F.col("x"), df_), x=x) == pytest.approx(p, rel=1e-4)


def test_split_models(spark):
    train = spark.createDataFrame([("a", [0.0, 0.0], "x"), ("a", [1.0, 1.0], "y"), ("b", [0.0, 0.0], "x")], "v string, e array<double>, l string")
    rows = spark.createDataFrame([(1, "a", [0.1, 0.0]), (2, "b", [1.0, 1.0]), (3, "c", [1.0, 1.0])], "i int, v string, e array<double>")
    got = {r["i"]: (r["x"], r["y"]) for r in models.split_scores(train, rows, ["v"], "e", "l", ["x", "y"], ["i"]).collect()}
    assert got[1][0] > 0.5 and got[2] == (1.0, 0.0) and got[3] == (None, None)


def test_regions(spark):
    df = spark.createDataFrame([("AA", "BB", "CCC")], "cdr1_seq_aa_q_trim string, cdr2_seq_aa_q_trim string, cdr3_seq_aa_q_trim string")
    assert models.regions(df, "cdr1_cdr2_cdr3").first()["text"] == "AABBCCC"
    with pytest.raises(Exception, match="blank cdr3"):
        models.regions(df.withColumn("cdr3_seq_aa_q_trim", F.lit(" ")), "cdr3").collect()


def test_knn_is_exact(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(40)], "vec_id long, embedding array<double>")
    got = {(r["center_id"], r["rank"]): r["neighbor_id"] for r in vectors.knn(df, 3).collect()}
    points = {i: (i % 7, i // 7) for i in range(40)}
    for i, p in points.items():
        near = sorted((math.dist(p, q), j) for j, q in points.items() if j != i)[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in near]


def test_legacy(spark):
    reads_ = spark.createDataFrame([("ACGTTTTTTTTTTGGGG",), ("ACCTTTTTTTTTTGGGG",), ("TTTT",)], "sequence string")
    got = [r["trimmed"] for r in legacy.trim_primers(reads_, "ACGT", "GGGG", 2, 5).collect()]
    assert got == ["TTTTTTTTT", "TTTTTTTTT", None]
    with pytest.raises(ValueError):
        legacy.select_by(reads_, a=[1], b=[2])


def test_readers(spark, tmp_path):
    (tmp_path / "empty.tsv").write_text("nucleotide\taminoAcid\tcount\n")
    assert tables.common_columns(tables.sample_file(spark, str(tmp_path / "empty.tsv"), "s"), True).count() == 0
    (tmp_path / "a.csv").write_text("count,templates,cdr3nt,cdr3aa\n3,NA,acg,CA.W\n4,2,acc,N/A\n")
    got = [tuple(r) for r in tables.common_columns(tables.sample_file(spark, str(tmp_path / "a.csv"), "s"), True).collect()]
    assert got == [("s", "ACG", "CAW", 3), ("s", "ACC", None, 4)]
    (tmp_path / "x.fasta").write_text(">one 1\nACG\nTT\n>two\nGG\n")
    assert {(r["name"], r["sequence"]) for r in sequences.fasta(spark, str(tmp_path / "x.fasta")).collect()} == {("one 1", "ACGTT"), ("two", "GG")}
    (tmp_path / "x.fastq").write_text("@r1\nACG\n+\nIII\n@r2\nGG\n+\nII\n")
    assert {(r["name"], r["sequence"], r["quality"]) for r in sequences.fastq(spark, str(tmp_path / "x.fastq")).collect()} == {("r1", "ACG", "III"), ("r2", "GG", "II")}
    (tmp_path / "x.clstr").write_text(">Cluster 0\n0\t12aa, >a... *\n1\t11aa, >b... at 95.00%\n>Cluster 1\n0\t9aa, >c... *\n")
    got = {(r["cluster"], r["member"], r["length"], r["identity"], r["is_representative"]) for r in sequences.cdhit_clusters(spark, str(tmp_path / "x.clstr")).collect()}
    assert got == {(0, "a", 12, None, True), (0, "b", 11, 95.0, False), (1, "c", 9, None, True)}
    (tmp_path / "lists.txt").write_text("a\tb\tc\nd,e\n")
    assert sequences.member_lists(spark, str(tmp_path / "lists.txt")).where("is_representative").count() == 2


NUCLEOTIDE = """header
Query= r1|1

V-(D)-J rearrangement summary for query sequence
IGHV1-2*02,IGHV1-2*04\tIGHD3-3*01\tIGHJ4*02\tVH\tNo\tIn-frame\tYes\t+

V-(D)-J junction details based on top germline gene matches
GAGAG\t(AC)\tTTT\tN/A\tCC\t

V  95.0% (280/295)  IGHV1-2*02  4  CAGG  283

Query= r2|2

***** No hits found *****

  Database: x
"""


def test_reports(spark, tmp_path):
    (tmp_path / "n.txt").write_text(NUCLEOTIDE)
    rows = sequences.nucleotide_report(spark, str(tmp_path / "n.txt"), "BCR").collect()
    assert [r["name"] for r in rows] == ["r1|1"] and rows[0]["v_call"] == "IGHV1-2*02" and rows[0]["productive"] is True and rows[0]["overlap"] is True
    assert sequences.nucleotide_report(spark, str(tmp_path / "n.txt"), "TCR").count() == 0
    text = "Query= q1\n>V1*01\n\nFR1-IMGT\t1\t4\t4\t4\t0\t0\t100\nCDR1-IMGT\t5\t6\t2\t1\t1\t0\t50\n\n  Database: y\n"
    (tmp_path / "p.txt").write_text(text)
    got = sequences.protein_report(spark, str(tmp_path / "p.txt"), spark.createDataFrame([("q1", "ABCDEF")], "name string, sequence string")).first()
    assert got["fr1"] == "ABCD" and got["cdr1"] == "EF" and got["identity"] == pytest.approx((4 * 100 + 2 * 50) / 6)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", "2020-01-01", 1)], "participant_label string, specimen_label string, x int")
    sinks.partitioned(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first()["specimen_label"] == "2020-01-01"
    sinks.by_participant(df, str(tmp_path / "p"))
    assert (tmp_path / "p" / "participant_label=p").exists()


def test_streaming_counts(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = counts.windowed_counts(stream, "ts", ["k"]).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["k"], r["n"]) for r in spark.table("counted").collect()} == {("a", 2), ("b", 1)}
