"""Queries: filters, scalars, labels and samples, each rule on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checks import checked_loss, unique_slugs
from ..functions import sequence as seq
from ..functions import vocab
from ..operators import association, clustering, combine, composition, folds, legacy, metadata, reads, rollup, windows
from ..schema import REGIONS
from ..sources import tables as layouts
from .catalogue import query
from .roles import ISOTYPES, rows, sql
from .sequences import ABC, BLOCK, CONSENSUS_SQL, REACH_SQL, SCORE_SQL, SEQ, recursive, scores
from .tables import _DNA, dna, rounded, table


# Filters of reads.
@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority IN ('1-URGENT', '5-LOW')")
def run_filter(spark, sf):
    o = table(spark, sf, "orders").withColumn("flag", F.col("o_orderstatus") == "F").withColumnRenamed("o_orderpriority", "run_label")
    return reads.of_run(o, "flag", ["1-URGENT", "5-LOW"]).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND p_size % 5 > 0 AND p_retailprice / 3 > 200")
def functional_reads(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") % 3 != 0).alias("productive"), F.when(F.col("p_size") % 5 > 0, F.col("p_brand")).alias("extracted_isotype"), (F.col("p_retailprice") / 3).alias("v_score"), F.lit("BCR").alias("amplification_locus")
    )
    return reads.functional(reads.require_locus(p, "BCR"), "BCR").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size % 10 <> 0 AND " + " AND ".join(f"p_partkey % {11 + i} <> 0 AND p_partkey % {23 + i} <> 0" for i in range(len(REGIONS))))
def complete_rows(spark, sf):
    region = lambda i: F.when(F.col("p_partkey") % (11 + i) == 0, F.lit(None)).when(F.col("p_partkey") % (23 + i) == 0, "CA*R").otherwise("CARW")
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("v_gene"), F.col("p_type").alias("j_gene"), *[region(i).alias(f"{r}_seq_aa_q_trim") for i, r in enumerate(REGIONS)])
    return reads.complete(p).select("p_partkey")


@query("SELECT p_partkey, p_brand AS v_gene, true AS listed FROM part WHERE p_brand LIKE 'Brand#1%' UNION ALL SELECT DISTINCT NULL, p_brand, false FROM part WHERE p_brand NOT LIKE 'Brand#1%'")
def known_genes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("v_gene"))
    kept, missing = reads.known_genes(p, p.select("v_gene").distinct().where("v_gene LIKE 'Brand#1%'"), "v_gene")
    return kept.select("p_partkey", "v_gene", F.lit(True).alias("listed")).union(missing.select(F.lit(None).cast("long"), "v_gene", F.lit(False)))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_tax AS a, l_discount AS b FROM lineitem WHERE l_linenumber <> 3")
def scored_only(spark, sf):
    keep = lambda c: F.when(F.col("l_linenumber") != 3, F.col(c))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", keep("l_tax").alias("a"), keep("l_discount").alias("b"))
    return rollup.scored_rows(li, ["a", "b"])


@query("SELECT p_partkey FROM part WHERE (p_size % 4 = 0 OR p_size <= 20) AND p_brand IN ('Brand#11', 'Brand#23', 'Brand#55')")
def not_spam(spark, sf):
    p = table(spark, sf, "part").withColumn("spam_score", F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("double")))
    return legacy.select_by(legacy.not_spam(p, 20.0), p_brand=["Brand#11", "Brand#23", "Brand#55"], p_type=None).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size % 6 <> 0")
def real_families(spark, sf):
    gene = F.when(F.col("p_size") % 6 == 0, F.concat(F.lit("VH"), "p_brand")).when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("IGHV"), "p_brand"))
    return reads.real_families(table(spark, sf, "part").select("p_partkey", gene.alias("v_gene"))).select("p_partkey")


@query(sql("SELECT specimen_label, CAST(sum(CASE WHEN NOT coalesce(isotype_supergroup = 'IGHD-M' AND v_mut < 0.01::DOUBLE, false) AND length(cdr3_seq_aa_q_trim) >= 11 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM r GROUP BY 1"))
def rows_after_filters(spark, sf):
    df = rows(spark, sf, ["specimen_label", "isotype_supergroup", "v_mut", "cdr3_seq_aa_q_trim"])
    return reads.rows_per_specimen(reads.mutated_or_other(df).where(F.length("cdr3_seq_aa_q_trim") >= 11), df)


# Columns and joins.
@query("SELECT p_partkey, p_size * p_retailprice AS \"f:size:g:price\", p_size * (p_partkey % 7) AS \"f:size:g:mod\", (p_size % 3) * p_retailprice AS \"f:third:g:price\", (p_size % 3) * (p_partkey % 7) AS \"f:third:g:mod\" FROM part")
def expanded_interactions(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("f:size"), (F.col("p_size") % 3).alias("f:third"), F.col("p_retailprice").alias("g:price"), (F.col("p_partkey") % 7).alias("g:mod"))
    return p.select("p_partkey", *vocab.interactions(vocab.expand(["f:*"], p.columns), vocab.expand(["g:*"], p.columns)))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_tax AS ill FROM lineitem")
def binary_probabilities(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (1 - F.col("l_tax")).alias("well"), F.col("l_tax").alias("ill"))
    return combine.one_of_two(li, ["well", "ill"], "ill")


@query("SELECT p_partkey, NULL AS missing, NULL AS n, CASE WHEN p_size % 5 < 4 THEN 'C1' || p_brand END AS cdr1 FROM part UNION ALL SELECT NULL, p_brand || '*04', count(*), NULL FROM part WHERE p_size % 5 = 4 GROUP BY p_brand")
def germline_fill(spark, sf):
    call = F.concat("p_brand", F.lit("*0"), (F.col("p_size") % 5).cast("string"))
    p = table(spark, sf, "part").select("p_partkey", call.alias("v_call"), "p_brand", "p_size")
    germlines = p.where("p_size % 5 < 4").select("v_call", F.concat(F.lit("C1"), "p_brand").alias("cdr1")).distinct()
    filled, missing = reads.fill_regions(p, germlines)
    none = F.lit(None)
    return filled.select("p_partkey", none.cast("string").alias("missing"), none.cast("long").alias("n"), "cdr1").union(missing.select(none.cast("long"), "v_call", "n", none.cast("string")))


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey % 100 <> 0")
def checked_loss_join(spark, sf):
    p = table(spark, sf, "part")
    left, right = p.select("p_partkey", "p_brand"), p.where("p_partkey % 100 <> 0").select("p_partkey")
    return checked_loss(left.join(right, "p_partkey"), left, right)


# Reports.
_JUNCTION = {"v_end": "p_size", "d_start": "p_size + p_partkey % 9", "d_end": "p_size + p_partkey % 9 + 5", "j_start": "p_size + p_partkey % 9 + p_partkey % 13", "v_germline_length": "60", "v_germline_end": "p_size", "d_germline_start": "1 + p_partkey % 4",
             "d_germline_end": "8 + p_partkey % 3", "d_germline_length": "12", "j_germline_start": "1 + p_partkey % 5", "identity": "p_retailprice / 20"}


@query("SELECT p_brand, round(avg(identity), 6) AS mean_identity, round(median(identity), 6) AS median_identity, round(avg(greatest(d_start - v_end - 1, 0)), 6) AS n1, round(avg(greatest(j_start - d_end - 1, 0)), 6) AS n2, round(avg(v_germline_length - v_germline_end), 6) AS chewed_v, round(avg(d_germline_start - 1), 6) AS chewed_d5, round(avg(d_germline_length - d_germline_end), 6) AS chewed_d3, round(avg(j_germline_start - 1), 6) AS chewed_j FROM (SELECT p_brand, " + ", ".join(f"{e} AS {n}" for n, e in _JUNCTION.items()) + " FROM part) GROUP BY 1")
def junction_lengths(spark, sf):
    out = legacy.junctions(table(spark, sf, "part").select("p_brand", *[F.expr(e).alias(n) for n, e in _JUNCTION.items()]), ["p_brand"])
    return rounded(out, *out.columns[1:])


@query(sql(", f AS (SELECT specimen_label, sum(CASE WHEN v_gene = 'Brand#11' AND num_reads > 45 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN v_gene = 'Brand#22' AND num_reads > 49 THEN 1 ELSE 0 END) AS b FROM r GROUP BY 1), l AS (SELECT DISTINCT specimen_label, disease FROM r), h AS (SELECT disease, 'a' AS class, CASE WHEN a > 0 THEN 1 ELSE 0 END AS hit FROM l JOIN f USING (specimen_label) UNION ALL SELECT disease, 'b', CASE WHEN b > 0 THEN 1 ELSE 0 END FROM l JOIN f USING (specimen_label)) SELECT disease, class, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 9) AS share FROM h GROUP BY 1, 2"))
def hits_by_class(spark, sf):
    df = rows(spark, sf, ["specimen_label", "disease", "v_gene", "num_reads"])
    hits = df.where("(v_gene = 'Brand#11' and num_reads > 45) or (v_gene = 'Brand#22' and num_reads > 49)")
    features = hits.groupBy("specimen_label").agg(F.sum((F.col("v_gene") == "Brand#11").cast("long")).alias("a"), F.sum((F.col("v_gene") == "Brand#22").cast("long")).alias("b"))
    return rounded(association.hit_shares(features, df.select("specimen_label", "disease").distinct(), "disease", ["a", "b"]), "share", digits=9)


# Ordered operations.
@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def first_rows(spark, sf):
    return windows.first_n(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS row_id_in_participant_table FROM orders")
def row_ids(spark, sf):
    return reads.row_ids(table(spark, sf, "orders"), "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "row_id_in_participant_table")


@query("SELECT p_partkey, CAST(coalesce(a, b, c) AS INTEGER) AS a, CAST(coalesce(b, c) AS INTEGER) AS b, c FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS a, CASE WHEN p_size % 3 = 0 THEN p_size + 1 END AS b, CASE WHEN p_size % 5 <> 0 THEN p_size + 2 END AS c FROM part)")
def backfilled_columns(spark, sf):
    size = F.col("p_size")
    p = table(spark, sf, "part").select("p_partkey", F.when(size % 2 == 0, size).alias("a"), F.when(size % 3 == 0, size + 1).alias("b"), F.when(size % 5 != 0, size + 2).alias("c"))
    return windows.backfilled(p, ["a", "b", "c"])


@query("WITH d AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey % 60 AS INTEGER) AS day, o_orderstatus FROM orders), c AS (SELECT o_custkey, arg_min(day, (abs(day - 15), day)) AS day FROM d WHERE day BETWEEN 10 AND 45 AND o_orderstatus <> 'P' GROUP BY 1) SELECT o_orderkey, CAST(d.day AS BIGINT) AS day, c.day IS NOT NULL AS is_peak FROM d LEFT JOIN c ON c.o_custkey = d.o_custkey AND c.day = d.day")
def peak_propagated(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 60).alias("day"), "o_orderstatus")
    chosen = windows.closest(d, ["o_custkey"], "day", 15, 10, 45, ["day", "o_orderkey"], allowed=F.col("o_orderstatus") != "P")
    return windows.propagated(d, chosen, ["o_custkey", "day"], "is_peak").select("o_orderkey", "day", "is_peak")


@query("SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part) WHERE tag <> '' GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def top_tags(spark, sf):
    counts = metadata.tags(table(spark, sf, "part"), "p_name", " ").groupBy("tag").agg(F.count("*").alias("n"))
    return windows.top_n(counts, [F.col("n").desc(), "tag"], 10)


_DRAW = "CAST('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), '{s}', '0')), 1, 8) AS BIGINT) % m"


@query(f"WITH k AS (SELECT p_brand || '|' || p_type AS k, row_number() OVER (ORDER BY p_brand || '|' || p_type) - 1 AS i FROM (SELECT DISTINCT p_brand, p_type FROM part)), d AS (SELECT id, {_DRAW.format(s='a')} AS x, {_DRAW.format(s='b')} AS y FROM (SELECT unnest(range(0, 2000)) AS id), (SELECT count(*) AS m FROM k)), p AS (SELECT least(x, y) AS x, greatest(x, y) AS y, min(id) AS id FROM d WHERE x <> y GROUP BY 1, 2 ORDER BY id LIMIT 500) SELECT a.k AS a, b.k AS b FROM p JOIN k a ON a.i = x JOIN k b ON b.i = y")
def random_pairs(spark, sf):
    return folds.random_pairs(table(spark, sf, "part").select(F.concat_ws("|", "p_brand", "p_type").alias("k")), "k", 500)


# Scalars.
@query("SELECT p_partkey, p_brand AS gene, CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS mapped, 'IGH' || p_brand AS heavy, CASE WHEN length(p_type) > 2 THEN substr(p_type, 2, length(p_type) - 2) END AS inner_type FROM part")
def gene_names(spark, sf):
    allele = F.concat("p_brand", F.lit("*0"), (F.col("p_size") % 4).cast("string"), F.lit(" (F)"))
    return table(spark, sf, "part").select(
        "p_partkey", seq.gene(allele).alias("gene"), vocab.mapped((F.col("p_size") % 3).cast("string"), {"0": "zero", "1": "one"}, pass_through=False).alias("mapped"),
        seq.heavy_name(F.concat(F.lit("Ig"), "p_brand")).alias("heavy"), seq.strip_ends("p_type").alias("inner_type"),
    )


_GERM = "translate(md5(CAST(p_partkey % 50 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTAC-.')"


@query(f"SELECT p_partkey, array_to_string(list_transform(generate_series(1, 32), lambda i: CASE WHEN substr(q, i, 1) = substr(g, i, 1) OR substr(g, i, 1) IN ('-', '.') THEN lower(substr(q, i, 1)) ELSE substr(q, i, 1) END), '') AS marked, CAST(length(g) - length(replace(g, '-', '')) AS INTEGER) AS inserted, CAST(0 AS INTEGER) AS deleted FROM (SELECT p_partkey, {_DNA} AS q, {_GERM} AS g FROM part)")
def mutation_marks(spark, sf):
    germ = F.translate(F.md5((F.col("p_partkey") % 50).cast("string")), "0123456789abcdef", "ACGTACGTACGTAC-.")
    return table(spark, sf, "part").select("p_partkey", seq.mutation_marks(dna(), germ).alias("marked"), seq.insertions(germ).alias("inserted"), seq.deletions(dna()).alias("deleted"))


_LOOP = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'WGWGFGAGWGWGFGAG')"


def _last(m):
    return f"(SELECT max(i) - 1 FROM generate_series(1, 29) g(i) WHERE regexp_matches(substr(s, CAST(i AS BIGINT), 4), '^{m}$'))"


@query(f"SELECT p_partkey, CAST(coalesce({_last('WA.W')}, {_last('FG.G')}, -1) AS INTEGER) AS place FROM (SELECT p_partkey, {_LOOP} AS s FROM part)")
def motif_places(spark, sf):
    loop = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "WGWGFGAGWGWGFGAG")
    return table(spark, sf, "part").select("p_partkey", seq.rightmost_motif(loop, ("WA.W", "FG.G")).alias("place"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ICU' WHEN 1 THEN 'No nephritis' END AS disease_severity FROM part")
def severities(spark, sf):
    subtype = F.when(F.col("p_size") % 3 == 0, "Covid19 - ICU").when(F.col("p_size") % 3 == 1, "Pediatric SLE - no nephritis").otherwise("Healthy")
    return metadata.severity(table(spark, sf, "part").withColumn("disease_subtype", subtype)).select("p_partkey", "disease_severity")


@query("SELECT p_partkey, 'CAS' || p_size AS cdr3, p_brand AS v_gene, p_type AS j_gene FROM part")
def identity_parts(spark, sf):
    p = table(spark, sf, "part").withColumn("bio", F.concat_ws("+", F.concat(F.lit("CAS"), F.col("p_size").cast("string")), "p_brand", "p_type"))
    return layouts.split_identity(p, "bio").select("p_partkey", "cdr3", "v_gene", "j_gene")


_TEMPLATE = "translate(md5(CAST(p_partkey % 50 AS VARCHAR)), '0123456789abcdef', 'xxxxxxxxxxx.....')"
_OTHER = "translate(md5(CAST(p_partkey % 70 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTAC--')"
_DASHED = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTAC--')"
_PAIRS = "list_filter(list_transform(generate_series(1, 32), lambda i: {'x': substr(a, i, 1), 'y': substr(b, i, 1)}), lambda p: NOT (p.x = '-' AND p.y = '-'))"


@query(f"SELECT p_partkey, array_to_string(list_transform(generate_series(1, 32), lambda i: CASE WHEN substr(t, i, 1) = '.' THEN '.' ELSE substr(s, i - CAST(length(substr(t, 1, i)) - length(replace(substr(t, 1, i), '.', '')) AS BIGINT), 1) END), '') AS gapped, array_to_string(list_transform({_PAIRS}, lambda p: p.x), '') AS one, array_to_string(list_transform({_PAIRS}, lambda p: p.y), '') AS two FROM (SELECT p_partkey, {_DNA} AS s, {_TEMPLATE} AS t, {_DASHED} AS a, {_OTHER} AS b FROM part)")
def gap_insertion(spark, sf):
    drawn = lambda key, letters: F.translate(F.md5(key.cast("string")), "0123456789abcdef", letters)
    key = F.col("p_partkey")
    one, two = seq.remove_double_gaps(drawn(key, "ACGTACGTACGTAC--"), drawn(key % 70, "ACGTACGTACGTAC--"))
    return table(spark, sf, "part").select("p_partkey", seq.insert_gaps(dna(), drawn(key % 50, "xxxxxxxxxxx.....")).alias("gapped"), one.alias("one"), two.alias("two"))


@query("SELECT DISTINCT p_brand, lower(replace(p_brand, '#', '-')) AS slug FROM part")
def file_slugs(spark, sf):
    return unique_slugs(table(spark, sf, "part").select("p_brand").distinct(), "p_brand")


_FORWARD, _REVERSE = "ACG", "GTA"


def _between(f, r):
    return f"regexp_extract(s, '^.{{0,6}}?(?:{f})(.*)(?:{r}).{{0,6}}$', 1)"


@query(f"SELECT p_partkey, CASE WHEN length(f) >= 10 THEN f END AS trimmed FROM (SELECT p_partkey, CASE WHEN x <> '' THEN x ELSE y END AS f FROM (SELECT p_partkey, {_between(_FORWARD, _REVERSE)} AS x, {_between(legacy.one_mismatch(_FORWARD), legacy.one_mismatch(_REVERSE))} AS y FROM (SELECT p_partkey, {_DNA} AS s FROM part)))")
def primer_trim(spark, sf):
    return legacy.trim_primers(table(spark, sf, "part").select("p_partkey", dna().alias("sequence")), _FORWARD, _REVERSE, 6, 10).select("p_partkey", "trimmed")


# Clusters of references, and by whole mismatches.
@query(recursive(CONSENSUS_SQL.replace("sum(num_reads) AS w", "1.0 AS w") + " SELECT v_gene, j_gene, cluster, consensus FROM con"))
def reference_clusters(spark, sf):
    return clustering.reference_clusters(rows(spark, sf, SEQ).distinct(), BLOCK, "cdr3_seq_aa_q_trim", 0.85)


@query(recursive(REACH_SQL.replace("hamming(a.s, b.s) / length(a.s)::DOUBLE <= 1.0::DOUBLE - 0.85::DOUBLE", "hamming(a.s, b.s) <= floor(length(a.s) - 0.8::DOUBLE * length(a.s))") + " SELECT * FROM cl"))
def legacy_mismatch_clusters(spark, sf):
    return clustering.cluster(rows(spark, sf, SEQ), BLOCK, "cdr3_seq_aa_q_trim", 0.8, clustering.legacy_mismatches).select(*SEQ, "cluster").distinct()


# Composition features of a specimen, and features without covariates.
_TYPES = ["BRUSHED", "PLATED", "TIN"]
_VJ = [f"Brand#{i}1|{t}" for i in (1, 2) for t in _TYPES]
_PAIR = "concat_ws('|', v_gene, CASE WHEN j_gene LIKE '%BRUSHED%' THEN 'BRUSHED' WHEN j_gene LIKE '%PLATED%' THEN 'PLATED' ELSE 'TIN' END)"


def _composed():
    out = []
    for i in ISOTYPES:
        own = f"isotype_supergroup = '{i}'"
        out.append(f"round(median(CASE WHEN {own} THEN v_mut END), 9) AS \"{i}:v_mut_median\", round(coalesce(avg(CASE WHEN {own} THEN CASE WHEN v_mut >= 0.01::DOUBLE THEN 1.0 ELSE 0.0 END END), 0.0), 9) AS \"{i}:mutated\"")
        listed = " + ".join(f"sum(CASE WHEN {own} AND pair = '{p}' THEN 1 ELSE 0 END)" for p in _VJ)
        out += [f"round(coalesce(sum(CASE WHEN {own} AND pair = '{p}' THEN 1 ELSE 0 END) / nullif(({listed})::DOUBLE, 0), 0.0), 9) AS \"{i}:{p}\"" for p in _VJ]
    return ", ".join(out)


@query(sql(f", x AS (SELECT specimen_label, isotype_supergroup, v_mut, {_PAIR} AS pair FROM r) SELECT specimen_label, {_composed()} FROM x GROUP BY 1"))
def composition_features(spark, sf):
    j = F.when(F.col("j_gene").contains("BRUSHED"), "BRUSHED").when(F.col("j_gene").contains("PLATED"), "PLATED").otherwise("TIN")
    df = rows(spark, sf, ["specimen_label", "isotype_supergroup", "v_mut", "v_gene", "j_gene"]).withColumn("j_gene", j)
    out = composition.composition(df, ISOTYPES, _VJ)
    return rounded(out, *out.columns[1:], digits=9)


@query("WITH f AS (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part WHERE p_partkey % 3 <> 0) SELECT p_partkey, round(p_retailprice - s * p_size - i, 4) AS p_retailprice FROM part, f")
def residual_features(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 3 != 0).alias("train"))
    return rounded(combine.residuals(p, ["p_retailprice"], ["p_size"], "train"), "p_retailprice", digits=4).select("p_partkey", "p_retailprice")


@query(sql(SCORE_SQL + ", x AS (SELECT sc.*, split_part(specimen_label, '|', 2) AS disease, split_part(specimen_label, '|', 1) AS person FROM sc) SELECT person, " + ", ".join(f"round(avg({c}), 9) AS {c}" for c in ABC) + ", arg_min(disease, (disease, l_orderkey)) AS disease FROM x GROUP BY 1"))
def person_scores(spark, sf):
    s = scores(spark, sf).withColumn("disease", F.split("specimen_label", r"\|")[1]).withColumn("person", F.split("specimen_label", r"\|")[0])
    return rounded(rollup.by_person(s, "person", ABC, "disease", "disease"), *ABC, digits=9)


# Cleaning of labels.
@query("SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND p_size % 4 <> 0")
def known_values(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "ND").otherwise("x").alias("a"), F.when(F.col("p_size") % 4 == 0, "ND").otherwise("y").alias("b"))
    return metadata.known_values(p, ["a", "b"]).select("p_partkey")


@query("SELECT p_brand AS cluster, min(p_partkey) AS p_partkey, 'IGHG' AS isotype, CAST(coalesce(arg_min(CASE WHEN p_size % 2 = 0 THEN p_size END, p_partkey) FILTER (WHERE true), 0) AS INTEGER) AS size, 1.5 AS weight FROM (SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1) GROUP BY 1")
def cluster_rows(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), "p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"))
    return metadata.one_per_cluster(p, "cluster", ["p_partkey"], {"isotype": "IGHG"}, {"size": 0, "weight": 1.5})


@query("SELECT DISTINCT p_type || '-' || p_brand AS label FROM part")
def unique_label_names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("study_name"), F.col("p_brand").alias("label")).distinct()
    return metadata.unique_labels(p, ["label"]).select("label")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, p_type) AS disease_subtype FROM part")
def default_values(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("disease_subtype"), F.col("p_type").alias("disease"))
    return metadata.defaults(p, {"disease_subtype": "disease"}).select("p_partkey", "disease_subtype")


@query("SELECT p_partkey, p_size % 2 = 0 AS has_BCR, p_size % 2 = 1 AS has_TCR, CASE WHEN p_size % 2 = 0 THEN 'BCR' ELSE 'TCR' END AS loci FROM part")
def presence_flags(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "BCR").otherwise("TCR").alias("gene_locus"))
    out = metadata.loci(metadata.presence(p, "gene_locus"), {"BCR": "has_BCR", "TCR": "has_TCR"})
    return out.select("p_partkey", "has_BCR", "has_TCR", F.array_join("loci", ",").alias("loci"))


@query(sql("SELECT class, p, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['x', 'y']) AS class, unnest([v_mut, num_reads / 50.0]) AS v FROM r), (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.5::DOUBLE]) AS p) WHERE v <= p GROUP BY 1, 2"))
def p_value_grid(spark, sf):
    df = rows(spark, sf, ["v_mut", "num_reads"]).select(F.col("v_mut").alias("p_x"), (F.col("num_reads") / 50.0).alias("p_y"))
    return association.counts_below(df, [0.01, 0.05, 0.5], ["x", "y"]).where("n > 0")



