"""Queries: reads, clones, composition, associations, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import association, clustering, composition, reads, rollup
from .catalogue import query
from .roles import CLASSES, ISOTYPES, TIES, TIES_SQL, V_GENES, rows, sql

CLONE = ["specimen_label", "isotype_supergroup", "igh_or_tcrb_clone_id"]
CLONE_SQL = ", ".join(CLONE)
SEQ = ["v_gene", "j_gene", "cdr3_seq_aa_q_trim"]
SEQ_SQL = ", ".join(SEQ)
IN_CLASSES = "(" + ", ".join(f"'{c}'" for c in CLASSES) + ")"


def ordered(names):
    return [F.col(n) for n in names]


@query(sql(f"""SELECT specimen_label, {SEQ_SQL}, CAST(count(*) AS BIGINT) AS num_reads, CAST(sum(num_reads) AS BIGINT) AS total_reads,
  arg_min(v_mut, ({TIES_SQL})) AS v_mut FROM r GROUP BY ALL"""))
def num_reads_dedupe(spark, sf):
    df = rows(spark, sf, ["specimen_label", *SEQ, "num_reads", "v_mut", *TIES])
    out = reads.count_reads(df.withColumnRenamed("num_reads", "n"), ["specimen_label", *SEQ], TIES, ["v_mut"], sums={"total_reads": "n"})
    return out.select("specimen_label", *SEQ, "num_reads", "total_reads", "v_mut")


SAMPLED_SQL = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {CLONE_SQL} ORDER BY num_reads DESC, {TIES_SQL}) AS rn,
  sum(num_reads) OVER (PARTITION BY {CLONE_SQL}) AS total_clone_num_reads, count(*) OVER (PARTITION BY {CLONE_SQL}) AS num_clone_members FROM r) WHERE rn = 1"""


def sampled(spark, sf, columns):
    return reads.one_per_clone(rows(spark, sf, list(dict.fromkeys([*CLONE, "num_reads", *columns, *TIES]))), CLONE, ordered(TIES))


@query(sql(f"""SELECT {CLONE_SQL}, v_gene, j_gene, num_reads, v_mut, CAST(total_clone_num_reads AS BIGINT) AS total_clone_num_reads, CAST(num_clone_members AS BIGINT) AS num_clone_members
  FROM ({SAMPLED_SQL})"""))
def clone_sample(spark, sf):
    return sampled(spark, sf, ["v_gene", "j_gene", "v_mut"]).select(*CLONE, "v_gene", "j_gene", "num_reads", "v_mut", "total_clone_num_reads", "num_clone_members")


GATE = {"IGHG": 5, "IGHA": 5, "IGHD-M": 8}
GATE_SQL = f""",
k AS (SELECT * FROM r WHERE length(cdr3_seq_aa_q_trim) >= 8),
c AS (SELECT specimen_label FROM k GROUP BY 1 HAVING count(DISTINCT CASE WHEN isotype_supergroup = 'IGHG' THEN igh_or_tcrb_clone_id END) >= 5
  AND count(DISTINCT CASE WHEN isotype_supergroup = 'IGHA' THEN igh_or_tcrb_clone_id END) >= 5 AND count(DISTINCT CASE WHEN isotype_supergroup = 'IGHD-M' THEN igh_or_tcrb_clone_id END) >= 8),
m AS (SELECT k.* FROM k JOIN c USING (specimen_label) WHERE NOT coalesce(isotype_supergroup = 'IGHD-M' AND v_mut < 0.01::DOUBLE, false)),
e AS (SELECT m.* FROM m WHERE specimen_label IN (SELECT specimen_label FROM m GROUP BY 1 HAVING count(*) >= 20)),
s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {CLONE_SQL} ORDER BY num_reads DESC, {TIES_SQL}) AS rn FROM e) WHERE rn = 1)
SELECT s.specimen_label, s.isotype_supergroup, CAST(count(*) AS BIGINT) AS clones, CAST(sum(num_reads) AS BIGINT) AS reads FROM s
WHERE specimen_label IN (SELECT specimen_label FROM s GROUP BY 1 HAVING count(DISTINCT isotype_supergroup) = 3) GROUP BY 1, 2"""


@query(sql(GATE_SQL))
def specimen_gate(spark, sf):
    df = rows(spark, sf, [*CLONE, "num_reads", "v_mut", "cdr3_seq_aa_q_trim", *TIES])
    kept = reads.sample_clones(df, GATE, 20, CLONE, ordered(TIES))
    return kept.groupBy("specimen_label", "isotype_supergroup").agg(F.count("*").alias("clones"), F.sum("num_reads").alias("reads"))


def _round(df, *names, digits=9):
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


VJ_SQL = f""", s AS ({SAMPLED_SQL}), n AS (SELECT specimen_label, isotype_supergroup, v_gene, j_gene, %s AS n FROM s GROUP BY ALL)
SELECT specimen_label, isotype_supergroup, v_gene, j_gene, round(n / sum(n) OVER (PARTITION BY specimen_label, isotype_supergroup), 9) AS frequency FROM n"""


@query(sql(VJ_SQL % "count(*)"))
def vj_frequency(spark, sf):
    out = composition.frequencies(sampled(spark, sf, ["v_gene", "j_gene"]), ["specimen_label", "isotype_supergroup"], ["v_gene", "j_gene"])
    return _round(out.drop("n"), "frequency")


@query(sql(VJ_SQL % "sum(num_reads)"))
def vj_frequency_weighted(spark, sf):
    out = composition.frequencies(sampled(spark, sf, ["v_gene", "j_gene"]), ["specimen_label", "isotype_supergroup"], ["v_gene", "j_gene"], F.col("num_reads"))
    return _round(out.drop("n"), "frequency")


MATRIX_SQL = f""", s AS ({SAMPLED_SQL}) SELECT specimen_label, """ + ", ".join(
    f"round(sum(CASE WHEN v_gene = '{v}' THEN 1 ELSE 0 END) / sum(CASE WHEN v_gene IN ({', '.join(repr(x) for x in V_GENES)}) THEN 1 ELSE 0 END), 9) AS \"{v}\"" for v in V_GENES
) + " FROM s GROUP BY 1"


@query(sql(MATRIX_SQL))
def vj_matrix(spark, sf):
    matrix = composition.wide(sampled(spark, sf, ["v_gene"]), ["specimen_label"], "v_gene", V_GENES, F.count(F.lit(1)))
    return _round(composition.normalised(matrix, V_GENES), *V_GENES)


@query(sql("SELECT specimen_label, isotype_supergroup, round(median(v_mut), 9) AS v_mut_median FROM r GROUP BY ALL"))
def vmut_median(spark, sf):
    return rows(spark, sf, ["specimen_label", "isotype_supergroup", "v_mut"]).groupBy("specimen_label", "isotype_supergroup").agg(F.round(F.median("v_mut"), 9).alias("v_mut_median"))


WM_SQL = """, w AS (SELECT specimen_label, v_mut AS x, sum(num_reads) AS w FROM r WHERE v_mut IS NOT NULL GROUP BY 1, 2),
u AS (SELECT *, sum(w) OVER (PARTITION BY specimen_label ORDER BY x) AS upto, sum(w) OVER (PARTITION BY specimen_label) AS total, lead(x) OVER (PARTITION BY specimen_label ORDER BY x) AS after FROM w)
SELECT specimen_label, round(CASE WHEN 2 * upto = total AND after IS NOT NULL THEN (x + after) / 2 ELSE x END, 9) AS weighted_median FROM u WHERE 2 * upto >= total AND 2 * (upto - w) < total"""


@query(sql(WM_SQL))
def vmut_weighted_median(spark, sf):
    return _round(composition.weighted_median(rows(spark, sf, ["specimen_label", "v_mut", "num_reads"]), ["specimen_label"], "v_mut", "num_reads"), "weighted_median")


@query(sql("""SELECT p.specimen_label, i.isotype_supergroup, round(coalesce(avg(CASE WHEN r.v_mut >= 0.05::DOUBLE THEN 1.0 WHEN r.v_mut IS NOT NULL THEN 0.0 END), 0.0), 9) AS proportion
  FROM (SELECT DISTINCT specimen_label FROM r) p CROSS JOIN (SELECT DISTINCT isotype_supergroup FROM r) i LEFT JOIN r ON r.specimen_label = p.specimen_label AND r.isotype_supergroup = i.isotype_supergroup GROUP BY 1, 2"""))
def mutated_share(spark, sf):
    df = rows(spark, sf, ["specimen_label", "isotype_supergroup", "v_mut"])
    return _round(composition.proportion(df, ["specimen_label"], ["isotype_supergroup"], F.col("v_mut") >= 0.05), "proportion")


@query(sql("""SELECT specimen_label, isotype_supergroup, round(sum(weight), 9) AS weight, round(min(weight), 12) AS each_weight FROM (
  SELECT specimen_label, isotype_supergroup, 1.0 / ((SELECT count(DISTINCT q.isotype_supergroup) FROM r q WHERE q.specimen_label = r.specimen_label) * count(*) OVER (PARTITION BY specimen_label, isotype_supergroup)) AS weight FROM r)
  GROUP BY 1, 2"""))
def isotype_weights(spark, sf):
    out = reads.balanced_weights(rows(spark, sf, ["specimen_label", "isotype_supergroup"]), "specimen_label", "isotype_supergroup")
    return out.groupBy("specimen_label", "isotype_supergroup").agg(F.round(F.sum("weight"), 9).alias("weight"), F.round(F.min("weight"), 12).alias("each_weight"))


@query(sql(f""", s AS ({SAMPLED_SQL}) SELECT {CLONE_SQL}, round(total_clone_num_reads / sum(total_clone_num_reads) OVER (PARTITION BY specimen_label), 12) AS weight FROM s"""))
def clone_size_weights(spark, sf):
    return _round(reads.share(sampled(spark, sf, []), "total_clone_num_reads", ["specimen_label"]), "weight", digits=12).select(*CLONE, "weight")


@query(sql(""", f AS (SELECT disease, v_gene, count(*) / sum(count(*)) OVER (PARTITION BY disease) AS f FROM r GROUP BY 1, 2), t AS (SELECT v_gene, max(f) AS top FROM f GROUP BY 1)
  SELECT v_gene, round(top, 9) AS top FROM t WHERE top >= (SELECT median(top) FROM t)"""))
def common_v_genes(spark, sf):
    return _round(composition.common_genes(rows(spark, sf, ["disease", "v_gene"]), "v_gene", "disease"), "top")


@query(sql("SELECT DISTINCT isotype_supergroup, v_gene, j_gene FROM r"))
def gene_lists(spark, sf):
    return rows(spark, sf, ["isotype_supergroup", "v_gene", "j_gene"]).distinct()


def _counts_sql(key):
    return f"SELECT {key}, " + ", ".join(f"CAST(count(DISTINCT CASE WHEN disease = '{c}' THEN participant_label END) AS BIGINT) AS \"{c}\"" for c in CLASSES) + f" FROM r GROUP BY {key}"


@query(sql(_counts_sql(SEQ_SQL)))
def exact_match_counts(spark, sf):
    return association.class_counts(rows(spark, sf, [*SEQ, "disease", "participant_label"]), SEQ, "disease", CLASSES)


def fisher_sql(key, counts, classes):
    """p of the right tail from a table of log factorials."""
    n = " + ".join(f'"{c}"' for c in classes)
    total = " + ".join(f'"t_{c}"' for c in classes)
    parts = ", ".join(
        f"""least(1.0, (SELECT sum(exp(k1.f - i1.f - i2.f + o1.f - o2.f - o3.f - a.f + n1.f + n2.f)) FROM generate_series(d."{c}", least("t_{c}", n)) g(i)
  JOIN lf k1 ON k1.k = "t_{c}" JOIN lf i1 ON i1.k = i JOIN lf i2 ON i2.k = "t_{c}" - i JOIN lf o1 ON o1.k = total - "t_{c}" JOIN lf o2 ON o2.k = n - i
  JOIN lf o3 ON o3.k = total - "t_{c}" - n + i JOIN lf a ON a.k = total JOIN lf n1 ON n1.k = n JOIN lf n2 ON n2.k = total - n)) AS "p_{c}\"""" for c in classes
    )
    names = ", ".join(f'"{c}"' for c in classes)
    on = " AND ".join(f'x."{c}" = y."{c}"' for c in classes)
    totals = ", ".join(f"CAST(count(DISTINCT CASE WHEN disease = '{c}' THEN participant_label END) AS BIGINT) AS \"t_{c}\"" for c in classes)
    return f""", cnt AS ({counts}), tot AS (SELECT {totals} FROM r), lf AS (SELECT k, coalesce((SELECT sum(ln(j)) FROM generate_series(1, k) h(j)), 0.0) AS f FROM generate_series(0, 1000) g(k)),
d AS (SELECT DISTINCT {names}, {n} AS n, {total} AS total, tot.* FROM cnt, tot), p AS (SELECT d.*, {parts} FROM d),
scored AS (SELECT x.*, {', '.join(f'y."p_{c}"' for c in classes)} FROM cnt x JOIN p y ON {on})"""


FISHER_SQL = fisher_sql(SEQ_SQL, _counts_sql(SEQ_SQL), CLASSES)
P = 0.3


def _scored(spark, sf, keys, df=None):
    df = rows(spark, sf, [*keys, "disease", "participant_label"]) if df is None else df
    counts = association.class_counts(df, keys, "disease", CLASSES)
    return association.fisher_right(counts, association.class_totals(df, "disease", CLASSES), CLASSES, keys)


@query(sql(FISHER_SQL + f" SELECT {SEQ_SQL}, " + ", ".join(f'round("p_{c}", 8) AS "p_{c}"' for c in CLASSES) + " FROM scored"))
def exact_match_fisher(spark, sf):
    return _scored(spark, sf, SEQ).select(*SEQ, *[F.round(f"p_{c}", 8).alias(f"p_{c}") for c in CLASSES])


_HITS = ", ".join(f"round(sum(CASE WHEN round(\"p_{c}\", 8) <= {P}::DOUBLE THEN 1 ELSE 0 END) * 1000.0 / count(*), 9) AS \"{c}\"" for c in CLASSES)


@query(sql(FISHER_SQL + f" , f AS (SELECT specimen_label, {_HITS} FROM (SELECT DISTINCT specimen_label, {SEQ_SQL} FROM r) LEFT JOIN scored USING ({SEQ_SQL}) GROUP BY 1) SELECT * FROM f WHERE " + " + ".join(f'"{c}"' for c in CLASSES) + " > 0"))
def exact_match_features(spark, sf):
    df = rows(spark, sf, ["specimen_label", *SEQ])
    scored = _scored(spark, sf, SEQ).select(*SEQ, *[F.round(f"p_{c}", 8).alias(f"p_{c}") for c in CLASSES])
    return _round(association.exact_features(df, scored, SEQ, P, CLASSES)[0], *CLASSES)


BLOCK = ["v_gene", "j_gene"]
NEAR_SQL = """, dist AS (SELECT DISTINCT v_gene, j_gene, cdr3_seq_aa_q_trim AS s FROM r),
e AS (SELECT a.v_gene, a.j_gene, a.s AS a, b.s AS b FROM dist a JOIN dist b ON a.v_gene = b.v_gene AND a.j_gene = b.j_gene AND length(a.s) = length(b.s) AND a.s <> b.s
  AND hamming(a.s, b.s) / length(a.s)::DOUBLE <= 1.0::DOUBLE - 0.85::DOUBLE)"""
# Reachability within a block; blocks hold few distinct sequences.
REACH_SQL = NEAR_SQL + """, reach AS (SELECT v_gene, j_gene, s, s AS t FROM dist UNION SELECT reach.v_gene, reach.j_gene, reach.s, e.b FROM reach JOIN e ON e.v_gene = reach.v_gene AND e.j_gene = reach.j_gene AND e.a = reach.t),
cl AS (SELECT v_gene, j_gene, s AS cdr3_seq_aa_q_trim, min(t) AS cluster FROM reach GROUP BY 1, 2, 3)"""


def recursive(body: str) -> str:
    return sql(body).replace("WITH r AS", "WITH RECURSIVE r AS", 1)


def clustered(spark, sf, columns=(), identity=0.85):
    df = rows(spark, sf, list(dict.fromkeys([*SEQ, *columns])))
    return clustering.cluster(df, BLOCK, "cdr3_seq_aa_q_trim", identity)


@query(recursive(REACH_SQL + " SELECT * FROM cl"))
def cluster_components(spark, sf):
    return clustered(spark, sf).select(*SEQ, "cluster").distinct()


@query(recursive(""", dist AS (SELECT DISTINCT participant_label, v_gene, cdr3_seq_aa_q_trim AS s FROM r),
e AS (SELECT a.participant_label, a.v_gene, a.s AS a, b.s AS b FROM dist a JOIN dist b ON a.participant_label = b.participant_label AND a.v_gene = b.v_gene AND length(a.s) = length(b.s) AND a.s <> b.s
  AND hamming(a.s, b.s) / length(a.s)::DOUBLE <= 1.0::DOUBLE - 0.9::DOUBLE),
reach AS (SELECT participant_label, v_gene, s, s AS t FROM dist UNION SELECT reach.participant_label, reach.v_gene, reach.s, e.b FROM reach JOIN e ON e.participant_label = reach.participant_label AND e.v_gene = reach.v_gene AND e.a = reach.t),
cl AS (SELECT participant_label, v_gene, s, min(t) AS cluster FROM reach GROUP BY 1, 2, 3)
SELECT participant_label, v_gene, s AS cdr3_seq_aa_q_trim, CAST(dense_rank() OVER (PARTITION BY participant_label ORDER BY v_gene, length(s), cluster) - 1 AS BIGINT) AS clone FROM cl"""))
def clone_calls(spark, sf):
    df = rows(spark, sf, ["participant_label", "v_gene", "cdr3_seq_aa_q_trim"]).distinct()
    out = clustering.numbered_clones(df, ["v_gene"], "cdr3_seq_aa_q_trim", 0.9, "participant_label")
    return out.select("participant_label", "v_gene", "cdr3_seq_aa_q_trim", F.col("igh_or_tcrb_clone_id").alias("clone"))


CONSENSUS_SQL = REACH_SQL + """, w AS (SELECT cl.v_gene, cl.j_gene, cluster, cl.cdr3_seq_aa_q_trim AS s, sum(num_reads) AS w FROM r JOIN cl USING (v_gene, j_gene, cdr3_seq_aa_q_trim) GROUP BY ALL),
votes AS (SELECT v_gene, j_gene, cluster, i, substr(s, i, 1) AS residue, sum(w) AS w FROM w, generate_series(1, 12) g(i) WHERE i <= length(s) GROUP BY ALL),
best AS (SELECT v_gene, j_gene, cluster, i, arg_min(residue, (-w, residue)) AS residue FROM votes GROUP BY ALL),
con AS (SELECT v_gene, j_gene, cluster, string_agg(residue, '' ORDER BY i) AS consensus FROM best GROUP BY ALL)"""


@query(recursive(CONSENSUS_SQL + " SELECT * FROM con"))
def cluster_consensus(spark, sf):
    return clustering.consensus(clustered(spark, sf, ["num_reads"]), [*BLOCK, "cluster"], "cdr3_seq_aa_q_trim", "num_reads")


CLUSTER_KEY = ["v_gene", "j_gene", "cluster"]
CLUSTER_FISHER_SQL = REACH_SQL + ", q AS (SELECT r.*, cluster FROM r JOIN cl USING (v_gene, j_gene, cdr3_seq_aa_q_trim))" + fisher_sql("", _counts_sql("v_gene, j_gene, cluster").replace("FROM r ", "FROM q "), CLASSES)


@query(recursive(CLUSTER_FISHER_SQL + " SELECT v_gene, j_gene, cluster, " + ", ".join(f'round("p_{c}", 8) AS "p_{c}"' for c in CLASSES) + " FROM scored"))
def cluster_fisher(spark, sf):
    df = clustered(spark, sf, ["disease", "participant_label"])
    return _scored(spark, sf, CLUSTER_KEY, df).select(*CLUSTER_KEY, *[F.round(f"p_{c}", 8).alias(f"p_{c}") for c in CLASSES])


# Assignment of all sequences to all clusters' consensus sequences.
ASSIGN_SQL = CONSENSUS_SQL + """, tgt AS (SELECT DISTINCT v_gene, j_gene, cdr3_seq_aa_q_trim AS s FROM r),
d AS (SELECT tgt.v_gene, tgt.j_gene, s, cluster, hamming(s, consensus) / length(s)::DOUBLE AS d FROM tgt JOIN con ON tgt.v_gene = con.v_gene AND tgt.j_gene = con.j_gene AND length(s) = length(consensus)),
near AS (SELECT v_gene, j_gene, s, min(d) AS distance, arg_min(cluster, (d, cluster)) AS nearest FROM d GROUP BY 1, 2, 3),
asg AS (SELECT tgt.v_gene, tgt.j_gene, tgt.s AS cdr3_seq_aa_q_trim, nearest, distance, CASE WHEN distance <= 1.0::DOUBLE - 0.85::DOUBLE THEN nearest END AS assigned FROM tgt LEFT JOIN near USING (v_gene, j_gene, s))"""


def assigned(spark, sf):
    made = clustering.consensus(clustered(spark, sf, ["num_reads"]), CLUSTER_KEY, "cdr3_seq_aa_q_trim", "num_reads")
    return clustering.assign(rows(spark, sf, SEQ).distinct(), made, BLOCK, "cdr3_seq_aa_q_trim", 0.85)


@query(recursive(ASSIGN_SQL + " SELECT v_gene, j_gene, cdr3_seq_aa_q_trim, nearest, round(distance, 9) AS distance, assigned, round(1 - coalesce(distance, 1.0), 9) AS proximity FROM asg"))
def nearest_centroid(spark, sf):
    out = assigned(spark, sf).withColumn("proximity", F.round(clustering.proximity(), 9))
    return _round(out, "distance").select(*SEQ, "nearest", "distance", "assigned", "proximity")


_CF = ", ".join(f"CAST(sum(CASE WHEN round(\"p_{c}\", 8) <= {P}::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS \"{c}\"" for c in CLASSES)
_LOW = "least(" + ", ".join(f'round("p_{c}", 8)' for c in CLASSES) + f") <= {P}::DOUBLE"


def _cluster_hits(spark, sf):
    df = clustered(spark, sf, ["disease", "participant_label", "specimen_label"])
    scored = _scored(spark, sf, CLUSTER_KEY, df).withColumns({f"p_{c}": F.round(f"p_{c}", 8) for c in CLASSES})
    key = F.concat_ws("|", *CLUSTER_KEY)
    return association.cluster_features(df.withColumn("key", key), scored.withColumn("key", key), "key", P, CLASSES)


@query(recursive(CLUSTER_FISHER_SQL + f" SELECT specimen_label, {_CF} FROM (SELECT DISTINCT specimen_label, v_gene, j_gene, cluster FROM q) JOIN scored USING (v_gene, j_gene, cluster) WHERE {_LOW} GROUP BY 1"))
def cluster_features(spark, sf):
    return _cluster_hits(spark, sf)[0]


# The first class's features alone, at a strict p, so that some specimens have none.
@query(sql(FISHER_SQL + f", hit AS (SELECT DISTINCT specimen_label FROM r JOIN scored USING ({SEQ_SQL}) WHERE round(\"p_{CLASSES[0]}\", 8) <= 0.02::DOUBLE) SELECT DISTINCT specimen_label FROM r WHERE specimen_label NOT IN (SELECT specimen_label FROM hit)"))
def abstentions(spark, sf):
    scored = _scored(spark, sf, SEQ).withColumn(f"p_{CLASSES[0]}", F.round(f"p_{CLASSES[0]}", 8))
    return association.exact_features(rows(spark, sf, ["specimen_label", *SEQ]), scored, SEQ, 0.02, CLASSES[:1])[1]


@query(sql(FISHER_SQL + " SELECT class, CAST(count(*) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS class, round(\"p_{c}\", 8) AS p FROM scored" for c in CLASSES) + f") WHERE p <= {P}::DOUBLE GROUP BY 1"))
def predictive_counts(spark, sf):
    scored = _scored(spark, sf, SEQ).withColumns({f"p_{c}": F.round(f"p_{c}", 8) for c in CLASSES})
    return association.predictive(scored, SEQ, P, CLASSES)


# Scores of three classes that add up to 1, from columns of the rows.
SCORE_SQL = f""", sc AS (SELECT specimen_label, isotype_supergroup, v_gene, num_reads AS weight, l_discount + 0.05::DOUBLE AS a, 0.2::DOUBLE + (l_linenumber % 5) * 0.03::DOUBLE AS b,
  1 - (l_discount + 0.05::DOUBLE) - (0.2::DOUBLE + (l_linenumber % 5) * 0.03::DOUBLE) AS c, {TIES_SQL} FROM (SELECT r.*, v_mut AS l_discount FROM r) r)"""
ABC = ["a", "b", "c"]


def scores(spark, sf):
    df = rows(spark, sf, ["specimen_label", "isotype_supergroup", "v_gene", "num_reads", "v_mut", *TIES])
    a, b = F.col("v_mut") + F.lit(0.05), F.lit(0.2) + (F.col("l_linenumber") % 5) * F.lit(0.03)
    return df.withColumn("a", a).withColumn("b", b).withColumn("c", 1 - a - b).withColumnRenamed("num_reads", "weight")


def _means(expr):
    return ", ".join(f"round({expr.format(c=c)}, 9) AS {c}" for c in ABC)


@query(sql(SCORE_SQL + f" SELECT specimen_label, {_means('sum({c} * weight) / sum(weight)')} FROM sc GROUP BY 1"))
def rollup_mean(spark, sf):
    return _round(rollup.weighted_mean(scores(spark, sf), ["specimen_label"], ABC, "weight"), *ABC)


_RANKED = ", ".join(f"row_number() OVER (PARTITION BY specimen_label ORDER BY {c}, {TIES_SQL}) AS r{c}" for c in ABC)
_TRIM = "sum(CASE WHEN r{c} > cut AND r{c} <= n - cut THEN {c} * weight END) / sum(CASE WHEN r{c} > cut AND r{c} <= n - cut THEN weight END)"


@query(sql(SCORE_SQL + f", k AS (SELECT *, {_RANKED}, count(*) OVER (PARTITION BY specimen_label) AS n, floor(0.1::DOUBLE * count(*) OVER (PARTITION BY specimen_label)) AS cut FROM sc), m AS (SELECT specimen_label, {', '.join(f'{_TRIM.format(c=c)} AS {c}' for c in ABC)} FROM k GROUP BY 1) SELECT specimen_label, round(a / (a + b + c), 9) AS a, round(b / (a + b + c), 9) AS b, round(c / (a + b + c), 9) AS c FROM m"))
def rollup_trimmed(spark, sf):
    return _round(rollup.trimmed(scores(spark, sf), ["specimen_label"], ABC, "weight", 0.1, TIES), *ABC)


@query(sql(SCORE_SQL + f", k AS (SELECT *, {_RANKED}, floor(0.1::DOUBLE * count(*) OVER (PARTITION BY specimen_label)) AS cut FROM sc) SELECT specimen_label, {_means('sum(CASE WHEN r{c} > cut THEN {c} * weight END) / sum(CASE WHEN r{c} > cut THEN weight END)')} FROM k GROUP BY 1"))
def rollup_trim_bottom(spark, sf):
    return _round(rollup.trimmed(scores(spark, sf), ["specimen_label"], ABC, "weight", 0.1, TIES, both=False), *ABC)


_H = " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / (a + b + c)) * ln({c} / (a + b + c)) ELSE 0 END" for c in ABC)


@query(sql(SCORE_SQL + f", h AS (SELECT *, round({_H}, 9) < round(0.8::DOUBLE * ln(3.0::DOUBLE), 9) AS sure FROM sc) SELECT specimen_label, {_means('coalesce(sum(CASE WHEN sure THEN {c} * weight END) / sum(CASE WHEN sure THEN weight END), 1.0 / 3)')} FROM h GROUP BY 1"))
def rollup_entropy(spark, sf):
    return _round(rollup.confident_mean(scores(spark, sf), ["specimen_label"], ABC, "weight", 0.8), *ABC)


def _median_sql(c):
    return f"""m{c} AS (SELECT specimen_label, CASE WHEN 2 * upto = total AND after IS NOT NULL THEN (x + after) / 2 ELSE x END AS {c} FROM (SELECT *, sum(w) OVER (PARTITION BY specimen_label ORDER BY x) AS upto, sum(w) OVER (PARTITION BY specimen_label) AS total,
  lead(x) OVER (PARTITION BY specimen_label ORDER BY x) AS after FROM (SELECT specimen_label, round({c}, 9) AS x, sum(weight) AS w FROM sc GROUP BY 1, 2)) WHERE 2 * upto >= total AND 2 * (upto - w) < total)"""


@query(sql(SCORE_SQL + ", " + ", ".join(map(_median_sql, ABC)) + " SELECT specimen_label, round(a, 9) AS a, round(b, 9) AS b, round(c, 9) AS c FROM ma JOIN mb USING (specimen_label) JOIN mc USING (specimen_label)"))
def rollup_median(spark, sf):
    return _round(rollup.medians(_round(scores(spark, sf), *ABC), ["specimen_label"], ABC, "weight"), *ABC)


_CELLS = [(c, i) for i in ISOTYPES for c in ABC]
RM_SQL = SCORE_SQL + ", mm AS (SELECT specimen_label, " + ", ".join(f"sum(CASE WHEN isotype_supergroup = '{i}' THEN {c} * weight END) / sum(CASE WHEN isotype_supergroup = '{i}' THEN weight END) AS \"{c}|{i}\"" for c, i in _CELLS) + " FROM sc GROUP BY 1)"


def _matrix(spark, sf):
    means = rollup.weighted_mean(scores(spark, sf), ["specimen_label", "isotype_supergroup"], ABC, "weight")
    return rollup.rollup_matrix(means, F.col("isotype_supergroup"), ISOTYPES, ABC)


@query(sql(RM_SQL + " SELECT specimen_label, " + ", ".join(f'round("{c}|{i}", 9) AS "{c}|{i}"' for c, i in _CELLS) + " FROM mm"))
def rollup_matrix(spark, sf):
    return _round(_matrix(spark, sf), *[f"{c}|{i}" for c, i in _CELLS])


@query(sql(RM_SQL + ", fr AS (SELECT specimen_label, " + ", ".join(f"sum(CASE WHEN isotype_supergroup = '{i}' THEN 1 ELSE 0 END) / count(*) AS \"f_{i}\"" for i in ISOTYPES) + " FROM r GROUP BY 1) SELECT specimen_label, " + ", ".join(f'round(coalesce("{c}|{i}", 1.0 / 3) * "f_{i}", 9) AS "{c}|{i}"' for c, i in _CELLS) + " FROM mm JOIN fr USING (specimen_label)"))
def rollup_reweighed(spark, sf):
    counts = composition.wide(rows(spark, sf, ["specimen_label", "isotype_supergroup"]), ["specimen_label"], "isotype_supergroup", ISOTYPES, F.count(F.lit(1)))
    out = rollup.reweighed(_matrix(spark, sf), composition.normalised(counts, ISOTYPES), ISOTYPES, ABC)
    return _round(out, *[f"{c}|{i}" for c, i in _CELLS])


@query(sql(""" SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT specimen_label) AS BIGINT) AS specimens FROM r WHERE NOT coalesce(isotype_supergroup = 'IGHD-M' AND v_mut < 0.01::DOUBLE, false) AND length(cdr3_seq_aa_q_trim) >= 8"""))
def row_filters(spark, sf):
    df = rows(spark, sf, ["specimen_label", "isotype_supergroup", "v_mut", "cdr3_seq_aa_q_trim"])
    kept = reads.mutated_or_other(df).where(F.length("cdr3_seq_aa_q_trim") >= vocab.MIN_CDR3)
    return kept.agg(F.count("*").alias("n"), F.count_distinct("specimen_label").alias("specimens"))
