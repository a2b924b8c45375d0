"""Queries: vectors, metrics, models, readers and writers, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..operators import graph, metrics, models, vectors
from ..operators import composition as comp
from ..sources import sequences, sinks, tables
from ..storage import Scratch
from ..streaming import counts
from .catalogue import query
from .roles import ROLE_SQL, V_GENES, rows, sql


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


_V = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_NEAR = f"""e AS ({_V}), d AS (SELECT a.vec_id AS center_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id),
nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY center_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10)"""

# The neighbourhood is a quarter of the mean batch, 10 to 50.
_MIXED = _NEAR.replace("nn AS", "k AS (SELECT CAST(least(50, greatest(10, count(*)::DOUBLE / count(DISTINCT label) // 4)) AS BIGINT) AS k FROM e),\nnn AS").replace("rank <= 10", "rank <= (SELECT k FROM k)")
_CHI = f"""{_MIXED}, s AS (SELECT label, count(*) / sum(count(*)) OVER () AS share FROM e GROUP BY 1), n AS (SELECT center_id, b.label, count(*) AS n FROM nn JOIN e b ON b.vec_id = neighbor_id GROUP BY 1, 2),
chi AS (SELECT e.vec_id AS center_id, sum(pow(coalesce(n, 0) - k * share, 2) / (k * share)) AS chi_square, count(*) - 1 AS df FROM e CROSS JOIN s CROSS JOIN k LEFT JOIN n ON n.center_id = e.vec_id AND n.label = s.label GROUP BY 1)"""
# The upper tail by the series of the lower incomplete gamma function; then both stages of the step-up procedure.
_REJECTED = f"""{_CHI}, p AS (SELECT center_id, 1 - (SELECT sum(exp((df / 2.0 + i) * ln(chi_square / 2) - chi_square / 2 - lgamma(df / 2.0 + i + 1))) FROM generate_series(0, 400) g(i)) AS p FROM chi),
o AS (SELECT p, row_number() OVER (ORDER BY p, center_id) AS rank, count(*) OVER () AS m FROM p), q AS (SELECT 0.05::DOUBLE / 1.05::DOUBLE AS q),
one AS (SELECT max(CASE WHEN p <= q * rank / m THEN rank ELSE 0 END) AS r1 FROM o, q), two AS (SELECT max(m) AS m, max(r1) AS r1, max(CASE WHEN p <= q * rank / greatest(m - r1, 1) THEN rank ELSE 0 END) AS r2 FROM o, q, one)"""


@query(f"WITH {_NEAR} SELECT center_id, neighbor_id, round(distance, 5) AS distance, rank FROM nn")
def knn_exact(spark, sf):
    return rounded(vectors.knn(table(spark, sf, "embeddings"), 10), "distance", digits=5)


@query(f"WITH {_MIXED} SELECT center_id, c.label AS center_label, b.label AS neighbor_label, CAST(count(*) AS BIGINT) AS n FROM nn JOIN e b ON b.vec_id = neighbor_id JOIN e c ON c.vec_id = center_id GROUP BY 1, 2, 3")
def kbet_counts(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.neighbourhood_counts(vectors.knn(e, vectors.batch_neighbourhood(e, "label")), e.select("vec_id", "label"), "vec_id", "label")


@query(f"WITH {_CHI} SELECT center_id, round(chi_square, 6) AS chi_square FROM chi")
def kbet_chi_square(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    labels = list(range(10))
    edges = vectors.knn(e, vectors.batch_neighbourhood(e, "label"))
    return rounded(vectors.mixing(edges, e, "vec_id", "label", labels).select("center_id", "chi_square"), "chi_square")


@query(f"WITH {_REJECTED} SELECT avg(CASE WHEN r1 = 0 THEN 0 WHEN r1 = m THEN m ELSE r2 END / m) AS rejection_rate FROM two")
def kbet_rejection(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    # The table's label is the batch; it has no second one, so all rows are one label's.
    return vectors.rejection_rates(e.withColumn("every", F.lit("every")), "label", "every").agg(F.avg("rejection_rate").alias("rejection_rate"))


_FREQ_SQL = "f AS (SELECT disease, v_gene, count(*) / sum(count(*)) OVER (PARTITION BY disease) AS f FROM r GROUP BY 1, 2)"


@query(sql(f", {_FREQ_SQL} SELECT a.disease AS a, b.disease AS b, round(sqrt(sum(pow(a.f - b.f, 2))), 6) AS euclidean, round(1 - sum(a.f * b.f) / (sqrt(sum(a.f * a.f)) * sqrt(sum(b.f * b.f))), 6) + 0.0 AS cosine FROM f a JOIN f b ON a.v_gene = b.v_gene AND a.disease <= b.disease GROUP BY 1, 2"))
def pairwise_distance(spark, sf):
    f = comp.frequencies(rows(spark, sf, ["disease", "v_gene"]), ["disease"], ["v_gene"])
    a, b = (f.select(F.col("disease").alias(n), "v_gene", F.col("frequency").alias(f"f{n}")) for n in ("a", "b"))
    met = a.join(b, "v_gene").where("a <= b").groupBy("a", "b")
    square = lambda x, y: F.sum(F.col(x) * F.col(y))
    out = met.agg(F.sqrt(F.sum(F.pow(F.col("fa") - F.col("fb"), F.lit(2)))).alias("euclidean"), (1 - square("fa", "fb") / (F.sqrt(square("fa", "fa")) * F.sqrt(square("fb", "fb")))).alias("cosine"))
    return rounded(out, "euclidean", "cosine").withColumn("cosine", F.col("cosine") + 0.0)


_EV = "SELECT event_type, floor(value) AS x, floor(value) * 0.5 + user_id AS y FROM events"
_RANK = "rank() OVER (PARTITION BY event_type ORDER BY {0}) + (count(*) OVER (PARTITION BY event_type, {0}) - 1) / 2.0"


@query(f"SELECT event_type, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(sqrt(avg((x - y) * (x - y))), 4) AS rmse, round(2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + pow(avg(x) - avg(y), 2)), 6) AS concordance FROM (SELECT *, {_RANK.format('x')} AS rx, {_RANK.format('y')} AS ry FROM ({_EV})) GROUP BY 1")
def replicate_agreement(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor("value").cast("double").alias("x"), (F.floor("value") * 0.5 + F.col("user_id")).alias("y"))
    return rounded(rounded(metrics.agreement(e, "x", "y", ["event_type"]), "pearson", "spearman", "concordance"), "rmse", digits=4)


_U = f"SELECT event_type, sum(p) AS n1, sum(1 - p) AS n0, sum(r * p) - sum(p) * (sum(p) + 1) / 2.0 AS u FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS p, {_RANK.format('x')} AS r FROM (SELECT event_type, user_id, round(value, 1) AS x FROM events)) GROUP BY 1"


def _tested(spark, sf):
    e = table(spark, sf, "events").select("event_type", "user_id", F.round("value", 1).alias("x"))
    return metrics.mann_whitney(e, "x", F.col("user_id") % 2 == 0, ["event_type"])


@query(f"SELECT event_type, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, u FROM ({_U})")
def mann_whitney_u(spark, sf):
    return _tested(spark, sf).select("event_type", "n1", "n0", "u")


@query(f"SELECT event_type, round(u / (n1 * n0), 9) AS auroc FROM ({_U})")
def auroc_by_class(spark, sf):
    return rounded(_tested(spark, sf).select("event_type", "auroc"), "auroc", digits=9)


_PRED = "SELECT o_orderpriority AS t, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS p FROM orders"


def _predictions(spark, sf):
    p = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).when(F.col("o_orderkey") % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("t"), p.alias("p"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"SELECT t, " + ", ".join(f"CAST(sum(CASE WHEN coalesce(p, 'Unknown') = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{x}\"" for x in [*PRIORITIES, "Unknown"]) + f" FROM ({_PRED}) GROUP BY 1")
def confusion_counts(spark, sf):
    return metrics.confusion(_predictions(spark, sf), "t", "p", PRIORITIES)


@query(f"WITH x AS (SELECT * FROM ({_PRED}) WHERE p IS NOT NULL), t AS (SELECT t AS k, count(*)::DOUBLE AS n FROM x GROUP BY 1), p AS (SELECT p AS k, count(*)::DOUBLE AS n FROM x GROUP BY 1), a AS (SELECT count(*)::DOUBLE AS s, sum(CASE WHEN t = p THEN 1 ELSE 0 END)::DOUBLE AS c FROM x) SELECT round((c * s - (SELECT sum(t.n * p.n) FROM t JOIN p USING (k))) / sqrt((s * s - (SELECT sum(n * n) FROM t)) * (s * s - (SELECT sum(n * n) FROM p))), 6) AS mcc FROM a")
def matthews_correlation(spark, sf):
    return rounded(metrics.matthews(_predictions(spark, sf).where("p IS NOT NULL"), "t", "p"), "mcc")


@query("SELECT o_orderstatus, round(sum(CASE WHEN pos AND hit THEN 1 ELSE 0 END) / sum(CASE WHEN pos THEN 1 ELSE 0 END)::DOUBLE, 6) AS sensitivity, round(sum(CASE WHEN NOT pos AND NOT hit THEN 1 ELSE 0 END) / sum(CASE WHEN NOT pos THEN 1 ELSE 0 END)::DOUBLE, 6) AS specificity FROM (SELECT o_orderstatus, o_orderpriority = '1-URGENT' AS pos, o_totalprice > 150000 AS hit FROM orders) GROUP BY 1")
def sensitivity_specificity(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").alias("pos"), (F.col("o_totalprice") > 150000).alias("hit"))
    count = lambda c: F.sum(c.cast("long"))
    p, h = F.col("pos"), F.col("hit")
    return o.groupBy("o_orderstatus").agg(F.round(count(p & h) / count(p), 6).alias("sensitivity"), F.round(count(~p & ~h) / count(~p), 6).alias("specificity"))


@query("SELECT CAST(round AS INTEGER) AS round, round(avg(v), 4) AS mean FROM (SELECT round, v, row_number() OVER (PARTITION BY round ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), CAST(round AS VARCHAR))), event_id) AS rn FROM (SELECT event_id, value AS v, unnest(generate_series(0, 4)) AS round FROM events)) WHERE rn <= 100 GROUP BY 1")
def bootstrap_means(spark, sf):
    return rounded(metrics.bootstrap(table(spark, sf, "events"), ["event_id"], "value", 5, 100), "mean", digits=4)


@query("SELECT CAST(length(lang) AS INTEGER) AS size, round(sum(n_chars * doc_id) / sum(n_chars)::DOUBLE, 4) AS mean, round(pow(2, -avg(n_chars) / 1000.0), 6) AS likelihood FROM (SELECT doc_id, n_chars, source AS lang FROM documents) GROUP BY 1")
def length_weighted_mean(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.length("source").alias("size"))
    return d.groupBy("size").agg(F.round(F.sum(F.col("n_chars") * F.col("doc_id")) / F.sum("n_chars"), 4).alias("mean"), F.round(F.pow(F.lit(2.0), -F.avg("n_chars") / 1000), 6).alias("likelihood"))


# Models; principal components have no statement, tests hold them against a decomposition of the covariance matrix.
@query()
def pca_features(spark, sf):
    f = comp.frequencies(rows(spark, sf, ["specimen_label", "v_gene"]), ["specimen_label"], ["v_gene"])
    wide = graph.cut(comp.wide(f, ["specimen_label"], "v_gene", V_GENES, F.sum("frequency")))
    return models.project(models.projection(wide, V_GENES, 3), wide, V_GENES).select("specimen_label", "components")


_SPLIT = """e AS (SELECT vec_id, vec_id % 3 AS v_gene, 'c' || CAST(label % 3 AS VARCHAR) AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
m AS (SELECT v_gene, label, d, avg(x) AS mean FROM e WHERE vec_id % 2 = 0 AND v_gene < 2 GROUP BY 1, 2, 3),
t AS (SELECT e.vec_id, e.v_gene, m.label, sum(pow(x - mean, 2)) AS d FROM e JOIN m ON m.v_gene = e.v_gene AND m.d = e.d WHERE vec_id % 2 = 1 GROUP BY 1, 2, 3),
w AS (SELECT vec_id, label, exp(min(d) OVER (PARTITION BY vec_id) - d) AS w FROM t), p AS (SELECT vec_id, label, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w)"""


@query(f"WITH {_SPLIT} SELECT a.vec_id, a.vec_id % 3 AS v_gene, " + ", ".join(f"round(CASE WHEN a.vec_id % 3 < 2 THEN coalesce((SELECT p FROM p WHERE p.vec_id = a.vec_id AND p.label = '{c}'), 0) END, 6) AS {c}" for c in ("c0", "c1", "c2")) + " FROM embeddings a WHERE a.vec_id % 2 = 1")
def split_models(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 3).alias("v_gene"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("label"))
    out = models.split_scores(e.where("vec_id % 2 = 0 and v_gene < 2"), e.where("vec_id % 2 = 1"), ["v_gene"], "embedding", "label", ["c0", "c1", "c2"], ["vec_id"])
    return rounded(out, "c0", "c1", "c2")


@query(sql("SELECT id AS igh_or_tcrb_clone_id, residue, round(CAST((length(s) - length(replace(s, residue, ''))) / length(s)::DOUBLE AS FLOAT)::DOUBLE, 6) AS share FROM (SELECT DISTINCT igh_or_tcrb_clone_id AS id, cdr3_seq_aa_q_trim AS s FROM r), (SELECT unnest(string_split('" + seq.AMINO_ACIDS + "', '')) AS residue)"))
def encoder_stub(spark, sf):
    cdr3 = rows(spark, sf, ["igh_or_tcrb_clone_id", "cdr3_seq_aa_q_trim"]).distinct()
    encoded = models.encode(models.regions(cdr3, "cdr3"), ids=["igh_or_tcrb_clone_id"])
    cells = encoded.select("igh_or_tcrb_clone_id", F.posexplode("embedding").alias("at", "share"))
    letters = F.array(*map(F.lit, seq.AMINO_ACIDS))
    return rounded(cells.select("igh_or_tcrb_clone_id", F.get(letters, F.col("at")).alias("residue"), F.col("share").cast("double").alias("share")), "share")


@query()
def scaled_embeddings(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return models.scaled_embeddings(e.where("vec_id % 2 = 0"), e, "embedding", 4).select("vec_id", "embedding_scaled")


# Readers and writers.
def _folder(spark):
    return Scratch(spark, "io").root


@query(f"WITH r AS ({ROLE_SQL}) SELECT DISTINCT participant_label, specimen_label, v_gene, num_reads FROM r")
def partitioned_roundtrip(spark, sf):
    path = _folder(spark)
    sinks.partitioned(rows(spark, sf, ["participant_label", "specimen_label", "v_gene", "num_reads"]).distinct(), path)
    back = tables.sampled_table(spark, path, rows(spark, sf, ["specimen_label"]).distinct())
    return back.select(F.col("participant_label").cast("string"), F.col("specimen_label").cast("string"), "v_gene", "num_reads")


@query(f"WITH r AS ({ROLE_SQL}) SELECT igh_or_tcrb_clone_id AS number, cdr3_seq_aa_q_trim AS sequence FROM (SELECT DISTINCT igh_or_tcrb_clone_id, cdr3_seq_aa_q_trim FROM r)")
def fasta_roundtrip(spark, sf):
    path = _folder(spark)
    sinks.fasta(rows(spark, sf, ["igh_or_tcrb_clone_id", "cdr3_seq_aa_q_trim"]).distinct().withColumn("name", F.lit("clone")), path, "name", "igh_or_tcrb_clone_id", "cdr3_seq_aa_q_trim")
    back = sequences.fasta(spark, path)
    return back.select(F.split("name", r"\|").getItem(1).cast("long").alias("number"), "sequence")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, CAST(CASE WHEN p_size > 25 THEN p_size END AS VARCHAR) AS p_size, 's1' AS sample_name FROM part")
def tsv_roundtrip(spark, sf):
    path = _folder(spark)
    sinks.tsv(table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("N/A").alias("p_size")), path)
    return tables.sample_file(spark, path, "s1")


@query(sql("SELECT v_gene, j_gene, cdr3_seq_aa_q_trim, string_agg(CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS ids FROM (SELECT DISTINCT v_gene, j_gene, cdr3_seq_aa_q_trim, igh_or_tcrb_clone_id AS k FROM r) GROUP BY 1, 2, 3"))
def shared_records(spark, sf):
    df = rows(spark, sf, ["v_gene", "j_gene", "cdr3_seq_aa_q_trim", "igh_or_tcrb_clone_id"]).distinct()
    return sinks.shared_records(df, ["v_gene", "j_gene"], "cdr3_seq_aa_q_trim", F.col("igh_or_tcrb_clone_id"))


@query("SELECT p_partkey AS id, p_brand AS v_call, CAST(NULL AS VARCHAR) AS d_call, CAST(NULL AS BIGINT) AS duplicate_count FROM part")
def airr_export(spark, sf):
    from pyspark.sql.types import LongType, StringType

    return sinks.airr(table(spark, sf, "part"), {"p_partkey": "id", "p_brand": "v_call"}, {"d_call": StringType(), "duplicate_count": LongType()})


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    return counts.windowed_counts(table(spark, sf, "events"), "ts", ["event_type"])
