"""Queries: joins, sets, scalars, windows, metadata, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checks import checked_join, enrich, shared_join
from ..functions import sequence as seq
from ..functions import vocab
from ..operators import clustering, combine, folds, legacy, metadata, reads, windows
from ..operators import composition as comp
from ..schema import SAMPLED, enforce
from .catalogue import query
from .roles import CLASSES, ISOTYPES, TIES, TIES_SQL, rows, sql


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


# Scalars over part and customer names.
@query("SELECT p_partkey, nullif(upper(trim(translate(concat(' .', p_name, '-* '), '.- *', ''))), '') AS trimmed, nullif(upper(trim(translate(CASE WHEN p_size % 2 = 0 THEN ' .-* ' END, '.- *', ''))), '') AS blank FROM part")
def trim_sequences(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", seq.trim_sequence(F.concat(F.lit(" ."), "p_name", F.lit("-* "))).alias("trimmed"), seq.trim_sequence(F.when(F.col("p_size") % 2 == 0, " .-* ")).alias("blank"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#1') THEN nullif(substr(p_brand, 8), '') ELSE p_brand END AS post, CASE WHEN length(p_type) > 2 THEN substr(p_type, 2, length(p_type) - 2) END AS inner_type FROM part")
def prefix_removal(spark, sf):
    return table(spark, sf, "part").select("p_partkey", seq.without_prefix("p_brand", F.lit("Brand#1")).alias("post"), seq.strip_ends("p_type").alias("inner_type"))


@query("SELECT p_partkey, split_part(split_part(concat('IGHV', p_size, '/OR', p_size % 7, '-', p_size % 5, '*01'), '-', 1), '/', 1) AS family, concat('IGHV', p_size, '/OR', p_size % 7, '-', p_size % 5) AS gene FROM part")
def v_family(spark, sf):
    s = F.col("p_size")
    allele = F.concat(F.lit("IGHV"), s.cast("string"), F.lit("/OR"), (s % 7).cast("string"), F.lit("-"), (s % 5).cast("string"), F.lit("*01"))
    return table(spark, sf, "part").select("p_partkey", seq.v_family(allele).alias("family"), seq.gene(allele).alias("gene"))


@query("SELECT p_partkey, round(length(regexp_replace(p_brand, '[^A-Z]', '', 'g')) / nullif(length(p_brand), 0)::DOUBLE, 6) AS rate FROM part")
def mutation_rate(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(seq.mutation_rate("p_brand"), 6).alias("rate"))


_DIST = "SELECT DISTINCT cdr3_seq_aa_q_trim AS s FROM r"
_COUNT = "(length(s) - length(translate(s, '{0}', '')))"
_HYDRO = " + ".join(f"{_COUNT.format(r)} * {v}::DOUBLE" for r, v in seq.HYDROPATHY.items())


@query(sql(f"SELECT s, CAST({_COUNT.format(seq.POSITIVE)} - {_COUNT.format(seq.NEGATIVE)} AS INTEGER) AS charge, round(({_HYDRO}) / {_COUNT.format(seq.AMINO_ACIDS)}, 6) + 0.0 AS hydropathy, CAST(length(s) AS INTEGER) AS n FROM ({_DIST})"))
def hydropathy(spark, sf):
    s = rows(spark, sf, ["cdr3_seq_aa_q_trim"]).select(F.col("cdr3_seq_aa_q_trim").alias("s")).distinct()
    return s.select("s", seq.charge("s").alias("charge"), (F.round(seq.hydropathy("s"), 6) + 0.0).alias("hydropathy"), F.length("s").alias("n"))


_DNA = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def dna(column="p_partkey"):
    return F.translate(F.md5(F.col(column).cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")


@query(f"SELECT p_partkey, reverse(translate({_DNA}, 'ACGT', 'TGCA')) AS reverse_complement FROM part")
def reverse_complement(spark, sf):
    return table(spark, sf, "part").select("p_partkey", seq.reverse_complement(dna()).alias("reverse_complement"))


_CODON_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in seq.CODONS.items()) + "}"


@query(f"SELECT p_partkey, array_to_string(list_transform(generate_series(0, 9), lambda i: ({_CODON_SQL})[substr({_DNA}, CAST(i * 3 + 1 AS BIGINT), 3)]), '') AS residues FROM part")
def translate_codons(spark, sf):
    return table(spark, sf, "part").select("p_partkey", seq.translate_codons(dna()).alias("residues"))


@query(sql(", d AS (" + _DIST + "), g AS (SELECT s, row_number() OVER (ORDER BY s) AS n FROM d) SELECT a.s AS a, b.s AS b, CAST(hamming(a.s, b.s) AS INTEGER) AS distance, round(hamming(a.s, b.s) / length(a.s)::DOUBLE, 6) AS share FROM d a JOIN d b ON length(a.s) = length(b.s) AND a.s < b.s"))
def hamming_pairs(spark, sf):
    d = rows(spark, sf, ["cdr3_seq_aa_q_trim"]).select(F.col("cdr3_seq_aa_q_trim").alias("a")).distinct().withColumn("n", F.length("a"))
    return rounded(clustering.pairwise(d, ["n"], "a"), "share").drop("n")


_KMER = "SELECT DISTINCT {k}, substr(s, CAST(i AS BIGINT), 8) AS m FROM (SELECT p_partkey AS {k}, " + _DNA + " AS s FROM part), generate_series(1, 25) g(i)"


@query(f"WITH q AS ({_KMER.format(k='query_id')}), f AS ({_KMER.format(k='ref_id')}), n AS (SELECT query_id, ref_id, CAST(count(*) AS BIGINT) AS shared FROM q JOIN f USING (m) GROUP BY 1, 2) SELECT query_id, ref_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, ref_id) AS rn FROM n) WHERE rn = 1")
def kmer_best_hit(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", dna().alias("sequence"))
    named = lambda name: p.withColumnRenamed("p_partkey", name)
    return legacy.kmer_best_hit(named("query_id"), named("ref_id"))


@query("SELECT p_partkey, CAST(tag AS VARCHAR) AS tag FROM (SELECT p_partkey, unnest(list_distinct(list_transform(string_split(p_name, ' '), lambda x: trim(x)))) AS tag FROM part) WHERE tag <> ''")
def tag_explode(spark, sf):
    return metadata.tags(table(spark, sf, "part"), "p_name", " ").select("p_partkey", "tag")


@query("SELECT l_returnflag, " + ", ".join(f"CAST(sum(CASE WHEN l_returnflag = '{v}' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS is_{v}" for v in "ANR") + " FROM lineitem GROUP BY 1")
def one_hot(spark, sf):
    hot = table(spark, sf, "lineitem").select("l_returnflag", *vocab.one_hot("l_returnflag", ["A", "N", "R"], "is_"))
    return hot.groupBy("l_returnflag").agg(*[F.sum(f"is_{v}").alias(f"is_{v}") for v in "ANR"])


@query("SELECT p_partkey, name, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR name IN (p_size, p_retailprice))")
def unpivot(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "value")


@query("SELECT name, CAST(row_number() OVER (ORDER BY a, b) AS INTEGER) AS place FROM (SELECT DISTINCT concat('IGHV', p_size % 12, '-', p_size) AS name, p_size % 12 AS a, p_size AS b FROM part)")
def natural_sort(spark, sf):
    name = F.concat(F.lit("IGHV"), (F.col("p_size") % 12).cast("string"), F.lit("-"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select(name.alias("name")).distinct().withColumn("place", F.row_number().over(Window.orderBy(seq.natural_key("name"))))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(nullif(regexp_extract(concat('Day ', o_orderkey % 40, ' or 9'), '-?[0-9]+', 0), '') AS INTEGER) WHEN o_orderstatus = 'O' THEN 0 END AS day FROM orders")
def day_extract(spark, sf):
    t = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Day "), (F.col("o_orderkey") % 40).cast("string"), F.lit(" or 9"))).when(F.col("o_orderstatus") == "O", "00:00:00").otherwise("visit 3")
    return table(spark, sf, "orders").select("o_orderkey", vocab.day_of(t).alias("day"))


_AGE = "(c_custkey * 7 % 120)"
_BINS = " ".join(f"WHEN {_AGE} < {b} THEN '{a}-{b}'" for a, b in zip(metadata.AGE_EDGES[:-2], metadata.AGE_EDGES[1:-1]))


@query(f"SELECT c_custkey, CASE {_BINS} END AS age_group, CASE WHEN {_AGE} < 80 THEN CASE WHEN {_AGE} < 50 THEN 'under 50' ELSE '50+' END END AS age_group_binary, CASE WHEN {_AGE} < 80 THEN CASE WHEN {_AGE} < 18 THEN 'under 18' ELSE '18+' END END AS age_group_pediatric FROM customer")
def age_bins(spark, sf):
    return metadata.age_groups(table(spark, sf, "customer").withColumn("age", F.col("c_custkey") * 7 % 120)).select("c_custkey", "age_group", "age_group_binary", "age_group_pediatric")


@query("SELECT s_suppkey, CASE WHEN ends_with(s_name, '1') THEN 'one' WHEN ends_with(s_name, '22') THEN 'two twos' WHEN ends_with(s_name, '2') THEN 'two' ELSE 'other' END AS category FROM supplier")
def suffix_category(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", vocab.first_suffix("s_name", [("1", "one"), ("22", "two twos"), ("2", "two")], "other").alias("category"))


@query("SELECT p_partkey, lower(p_brand) AS low, regexp_replace(regexp_replace(lower(trim(concat(p_brand, ' / ', p_type))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(concat('Ig', p_brand), '^Ig', 'IGH') AS heavy, split_part(concat(p_type, '+', p_brand, '+J1'), '+', 2) AS v_gene FROM part")
def text_functions(spark, sf):
    from ..sources.tables import split_identity

    p = table(spark, sf, "part").withColumn("bio_identity", F.concat("p_type", F.lit("+"), "p_brand", F.lit("+J1")))
    return split_identity(p, "bio_identity").select("p_partkey", F.lower("p_brand").alias("low"), seq.slug(F.concat("p_brand", F.lit(" / "), "p_type")).alias("slug"), seq.heavy_name(F.concat(F.lit("Ig"), "p_brand")).alias("heavy"), "v_gene")


@query("SELECT p_partkey, substr(q, CAST(lead + 1 AS BIGINT), CAST(greatest(length(q) - lead - tail, 0) AS BIGINT)) AS masked, CAST(length(g) - length(replace(g, '-', '')) AS INTEGER) AS insertions FROM (SELECT p_partkey, q, g, length(g) - length(ltrim(g, '.-')) AS lead, length(g) - length(rtrim(g, '.-')) AS tail FROM (SELECT p_partkey, " + _DNA + " AS q, concat(repeat('.', p_size % 5), substr(" + _DNA + ", CAST(p_size % 5 + 1 AS BIGINT), 10), '-', substr(" + _DNA + ", CAST(p_size % 5 + 12 AS BIGINT), CAST(32 - 11 - p_size % 5 - 3 AS BIGINT)), '---') AS g FROM part))")
def masked_query(spark, sf):
    k = (F.col("p_size") % 5).cast("int")
    q = dna()
    g = F.concat(F.repeat(F.lit("."), k), F.substring(q, k + 1, F.lit(10)), F.lit("-"), F.substring(q, k + 12, F.lit(18) - k), F.lit("---"))
    return table(spark, sf, "part").select("p_partkey", seq.mask_query(q, g).alias("masked"), seq.insertions(g).alias("insertions"))


# Joins, overrides, checks.
_LISTED = "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'OVER' END AS s FROM customer WHERE c_custkey % 5 < 2"


@query(f"SELECT o_orderkey, o_custkey, coalesce(s, o_orderpriority) AS o_orderpriority, c_mktsegment FROM orders JOIN ({_LISTED}) ON o_custkey = c_custkey")
def whitelist_join(spark, sf):
    listed = table(spark, sf, "customer").where("c_custkey % 5 < 2").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "OVER").alias("o_orderpriority_override"))
    return reads.on_whitelist(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), listed, ["o_custkey"], ["o_orderpriority"])


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'X' END, c_mktsegment) AS c_mktsegment FROM customer")
def override_columns(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "X").alias("c_mktsegment_override"))
    return vocab.overridden(c, ["c_mktsegment"])


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def checked_join_nation(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return checked_join(c, table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], validate="m:1").select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_missing(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("SELECT p_partkey, b.value AS brand, t.value AS type FROM part LEFT JOIN (SELECT p_partkey, p_brand AS value FROM part WHERE p_size > 10) b USING (p_partkey) LEFT JOIN (SELECT p_partkey, p_type AS value FROM part) t USING (p_partkey)")
def attribute_pivot(spark, sf):
    p = table(spark, sf, "part")
    attributes = p.where("p_size > 10").select("p_partkey", F.lit("brand").alias("name"), F.col("p_brand").alias("value")).union(p.select("p_partkey", F.lit("type"), "p_type"))
    return legacy.attribute_columns(p.select("p_partkey"), attributes, "p_partkey", ["brand", "type"])


@query("SELECT r_name, n_name, p_brand, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey GROUP BY 1, 2, 3")
def read_join(spark, sf):
    t = lambda n: table(spark, sf, n)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    )
    return joined.groupBy("r_name", "n_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.grp, b.grp) AS grp, x, y FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS grp, c_acctbal AS x FROM customer WHERE c_custkey % 3 < 2) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS grp, c_nationkey AS y FROM customer WHERE c_custkey % 3 > 0) b ON a.k = b.k AND a.grp IS NOT DISTINCT FROM b.grp")
def shared_full_join(spark, sf):
    c = table(spark, sf, "customer").withColumn("grp", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment"))).withColumnRenamed("c_custkey", "k")
    return shared_join(c.where("k % 3 < 2").select("k", "grp", F.col("c_acctbal").alias("x")), c.where("k % 3 > 0").select("k", "grp", F.col("c_nationkey").alias("y")), "k")


_PART_FEATURES = "SELECT c_custkey AS specimen_label, c_acctbal AS x FROM customer WHERE c_custkey % 3 <> {0}"


@query("SELECT a.specimen_label, a.x AS \"one:x\", b.x * 2 AS \"two:x\" FROM (" + _PART_FEATURES.format(0) + ") a JOIN (" + _PART_FEATURES.format(1) + ") b USING (specimen_label) WHERE specimen_label % 3 NOT IN (0, 1)")
def combine_models(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("specimen_label"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("disease"))
    part = lambda r, by: (c.where(F.col("specimen_label") % 3 != r).select("specimen_label", (F.col("x") * by).alias("x")), c.where(F.col("specimen_label") % 3 != r).select("specimen_label", "disease"), c.where(F.col("specimen_label") % 3 == r))
    return combine.combine({"one": part(0, 1), "two": part(1, 2)})[0]


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN (SELECT n_nationkey AS c_nationkey, n_name FROM nation WHERE n_regionkey < 3) USING (c_nationkey)")
def enrich_metadata(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return enrich(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), n)


@query("SELECT p_partkey, round(a * b, 6) AS \"a:b\", round(a * c, 6) AS \"a:c\", round(b * c, 6) AS \"b:c\" FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, (p_partkey % 7)::DOUBLE AS c FROM part)")
def interactions(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 7).cast("double").alias("c"))
    names = vocab.expand(["[a-c]"], p.columns)
    return rounded(p.select("p_partkey", *vocab.interactions(names, names)), "a:b", "a:c", "b:c")


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_intersection(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return combine.in_all([o, o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'")], "c_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, sf):
    o = table(spark, sf, "orders")
    pick = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey").distinct()
    return pick("O").exceptAll(pick("F"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P')")
def set_union(spark, sf):
    o = table(spark, sf, "orders")
    pick = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return pick("O").union(pick("P")).distinct()


@query("SELECT kind, CAST(key AS BIGINT) AS key, nation, balance FROM (SELECT 'customer' AS kind, c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL FROM supplier)")
def union_sources(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return folds.union_all([c, s])


# Windows.
_ORDERED = "SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price, o_orderstatus FROM orders"


@query(f"SELECT o_orderkey, round(coalesce(first_value(price IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(price IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS price FROM ({_ORDERED})")
def forward_fill(spark, sf):
    o = table(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")))
    return rounded(windows.filled(o, "price", ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "price"), "price")


@query(f"SELECT o_orderkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_id FROM ({_ORDERED})")
def cumulative_groups(spark, sf):
    return windows.group_numbers(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "group_id")


@query("SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def lagged(spark, sf):
    return windows.previous(table(spark, sf, "events"), "event_type", ["user_id"], ["ts", "event_id"], "before").select("event_id", "user_id", "before")


@query("SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0) / count(*) OVER (PARTITION BY event_type), 9) AS r FROM (SELECT event_id, event_type, round(value, 1) AS v FROM events)")
def rank_normalised(spark, sf):
    from ..operators.metrics import average_rank

    e = average_rank(table(spark, sf, "events").withColumn("v", F.round("value", 1)), "v", ["event_type"])
    return e.select("event_id", F.round(F.col("rank") / F.count("*").over(Window.partitionBy("event_type")), 9).alias("r"))


@query(sql("SELECT DISTINCT participant_label, arg_min(specimen_label, (abs(d - 15), specimen_label, d)) AS specimen_label, arg_min(d, (abs(d - 15), specimen_label, d)) AS day FROM (SELECT participant_label, specimen_label, CAST(date_diff('day', min(order_date) OVER (PARTITION BY participant_label), order_date) % 60 AS INTEGER) AS d FROM r) WHERE d BETWEEN 7 AND 40 GROUP BY participant_label"))
def peak_timepoint(spark, sf):
    df = rows(spark, sf, ["participant_label", "specimen_label", "order_date"])
    first = F.min("order_date").over(Window.partitionBy("participant_label"))
    days = df.withColumn("day", (F.datediff("order_date", first) % 60)).distinct()
    return windows.closest(days, ["participant_label"], "day", 15, 7, 40, ["specimen_label", "day"]).select("participant_label", "specimen_label", "day")


@query("SELECT event_id, min(event_type) OVER (PARTITION BY user_id) IS NOT DISTINCT FROM max(event_type) OVER (PARTITION BY user_id) AS single, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS INTEGER) AS code FROM events")
def group_codes(spark, sf):
    e = windows.one_value(table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_type")
    return windows.codes(e, ["event_type"], ["user_id"]).select("event_id", "single", "code")


# Metadata rules.
_SPEC = "SELECT DISTINCT c_custkey, c_mktsegment AS disease, concat(c_mktsegment, ' ', c_nationkey % 2) AS disease_subtype, r_name AS study_name, CASE WHEN c_custkey % 4 = 0 THEN 'adaptive' ELSE 'in_house' END AS data_source FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _specimens(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        "c_custkey", F.col("c_mktsegment").alias("disease"), F.concat_ws(" ", "c_mktsegment", (F.col("c_nationkey") % 2).cast("string")).alias("disease_subtype"),
        F.col("r_name").alias("study_name"), F.when(F.col("c_custkey") % 4 == 0, "adaptive").otherwise("in_house").alias("data_source"),
    )


@query(f"SELECT c_custkey, disease, study_name FROM ({_SPEC}) WHERE data_source = 'in_house' AND (disease = 'BUILDING' OR disease_subtype = 'MACHINERY 1') AND study_name <> 'ASIA' AND (study_name <> 'EUROPE' OR c_custkey % 2 = 0)")
def selection_rule(spark, sf):
    rule = metadata.Rule(sources=("in_house",), diseases=("BUILDING",), subtypes=("MACHINERY 1",), excluded=("ASIA",), by_study={"EUROPE": lambda d: d.where("c_custkey % 2 = 0")})
    return rule.apply(_specimens(spark, sf)).select("c_custkey", "disease", "study_name")


@query(f"SELECT c_custkey, disease FROM ({_SPEC}) WHERE study_name IN ('ASIA', 'EUROPE') AND disease IN ('BUILDING', 'FURNITURE') AND c_custkey % 3 = 1")
def target_filter(spark, sf):
    target = metadata.Target("disease", {"study_name": ("ASIA", "EUROPE"), "disease": ("BUILDING", "FURNITURE")}, ("disease_subtype",), lambda: F.col("c_custkey") % 3 == 1)
    return target.apply(_specimens(spark, sf)).select(*target.columns(["c_custkey"]))


@query("SELECT v, j, status FROM (SELECT DISTINCT p_brand AS v, p_type AS j, CASE WHEN p_size > 40 THEN 'Y' ELSE 'N' END AS status FROM part) QUALIFY count(*) OVER (PARTITION BY v, j) = 1")
def drop_conflicting_labels(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("v"), F.col("p_type").alias("j"), F.when(F.col("p_size") > 40, "Y").otherwise("N").alias("status"))
    return metadata.without_conflicts(p, ["v", "j"], "status")


@query("SELECT c_custkey, concat_ws('-', r_name, c_name) AS c_name, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, c_name) AS subtype, c_custkey % 2 = 0 AS \"has_BCR\", c_custkey % 2 = 1 AS \"has_TCR\", CASE WHEN c_custkey % 2 = 0 THEN ['BCR'] ELSE ['TCR'] END AS loci FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def specimen_labels(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    df = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("study_name", F.col("r_name"))
    df = metadata.presence(df.withColumn("locus", F.when(F.col("c_custkey") % 2 == 0, "BCR").otherwise("TCR")), "locus")
    df = metadata.loci(metadata.defaults(df.withColumn("subtype", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))), {"subtype": "c_name"}), {"BCR": "has_BCR", "TCR": "has_TCR"})
    return metadata.unique_labels(df, ["c_name"]).select("c_custkey", "c_name", "subtype", "has_BCR", "has_TCR", "loci")


@query("SELECT doc_id FROM documents WHERE (lower(coalesce(lang, '')) LIKE '%en%' OR lower(coalesce(source, '')) LIKE '%en%') AND NOT lower(coalesce(source, '')) LIKE '%1%'")
def named_targets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return d.where(F.lower("lang").contains("en")).transform(lambda x: metadata.names_target(x, ["lang", "source"], "source", "en")).where(~F.lower("source").contains("1")).select("doc_id")


# Reports.
@query(sql("SELECT participant_label, specimen_label, disease, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN isotype_supergroup = '{i}' THEN num_reads END), 0) AS BIGINT) AS \"reads {i}\", CAST(count(DISTINCT CASE WHEN isotype_supergroup = '{i}' THEN cdr3_seq_aa_q_trim END) AS BIGINT) AS \"unique {i}\"" for i in ISOTYPES) + " FROM r GROUP BY ALL"))
def read_counts_pivot(spark, sf):
    df = rows(spark, sf, ["participant_label", "specimen_label", "disease", "isotype_supergroup", "num_reads", "cdr3_seq_aa_q_trim"])
    keys = ["participant_label", "specimen_label", "disease"]
    long = df.groupBy(*keys, "isotype_supergroup").agg(F.sum("num_reads").alias("reads"), F.count_distinct("cdr3_seq_aa_q_trim").alias("unique"))
    pivoted = long.groupBy(*keys).pivot("isotype_supergroup", ISOTYPES).agg(F.first("reads").alias("reads"), F.first("unique").alias("unique"))
    return pivoted.select(*keys, *[F.coalesce(F.col(f"`{i}_{k}`"), F.lit(0)).alias(f"{k} {i}") for i in ISOTYPES for k in ("reads", "unique")])


@query(sql(f"SELECT specimen_label, igh_or_tcrb_clone_id, round(median(v_mut), 6) AS v_mut, CAST(sum(num_reads) AS BIGINT) AS num_reads, arg_min(v_gene, ({TIES_SQL})) AS v_gene, CAST(arg_min(length(cdr3_seq_aa_q_trim), ({TIES_SQL})) AS INTEGER) AS n FROM r GROUP BY 1, 2"))
def dotplot(spark, sf):
    df = rows(spark, sf, ["specimen_label", "igh_or_tcrb_clone_id", "v_mut", "num_reads", "v_gene", "cdr3_seq_aa_q_trim", *TIES])
    first = F.min_by(F.struct("v_gene", F.length("cdr3_seq_aa_q_trim").alias("n")), F.struct(*TIES))
    out = df.groupBy("specimen_label", "igh_or_tcrb_clone_id").agg(F.round(F.median("v_mut"), 6).alias("v_mut"), F.sum("num_reads").alias("num_reads"), first.alias("f"))
    return out.select("specimen_label", "igh_or_tcrb_clone_id", "v_mut", "num_reads", "f.v_gene", "f.n")


@query(sql("SELECT specimen_label, CAST(count(DISTINCT igh_or_tcrb_clone_id) AS BIGINT) AS clones, round(avg(length(cdr3_seq_aa_q_trim)), 6) AS mean_length, CAST(median(length(cdr3_seq_aa_q_trim)) AS DOUBLE) AS median_length, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1"))
def clones_per_specimen(spark, sf):
    df = rows(spark, sf, ["specimen_label", "igh_or_tcrb_clone_id", "cdr3_seq_aa_q_trim"]).withColumn("n", F.length("cdr3_seq_aa_q_trim"))
    return df.groupBy("specimen_label").agg(F.count_distinct("igh_or_tcrb_clone_id").alias("clones"), F.round(F.avg("n"), 6).alias("mean_length"), F.median("n").alias("median_length"), F.count("*").alias("n"))


@query(sql("SELECT disease, study_name, v_gene, round(avg(f), 6) AS mean, round(median(f), 6) AS median FROM (SELECT disease, study_name, specimen_label, v_gene, count(*) / sum(count(*)) OVER (PARTITION BY disease, study_name, specimen_label) AS f FROM r GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"))
def frequency_summaries(spark, sf):
    f = comp.frequencies(rows(spark, sf, ["disease", "study_name", "specimen_label", "v_gene"]), ["disease", "study_name", "specimen_label"], ["v_gene"])
    return f.groupBy("disease", "study_name", "v_gene").agg(F.round(F.avg("frequency"), 6).alias("mean"), F.round(F.median("frequency"), 6).alias("median"))


@query(sql("SELECT DISTINCT specimen_label, participant_label, disease, study_name FROM r"))
def specimen_metadata(spark, sf):
    return metadata.specimens(rows(spark, sf, ["specimen_label", "participant_label", "disease", "study_name"]), ["participant_label", "disease", "study_name"])


# Folds, overlaps, samples.
_PART = "SELECT DISTINCT participant_label AS p, disease AS d FROM r"


def _h(extra=""):
    return f"md5(concat_ws('|', p, '0{extra}'))"


FOLD_SQL = f""", pt AS ({_PART}), t AS (SELECT *, (row_number() OVER (PARTITION BY d ORDER BY {_h()}, p) - 1) % 3 AS test FROM pt), f AS (SELECT t.*, unnest([0, 1, 2, -1]) AS fold_id FROM t),
g AS (SELECT *, test <> fold_id AS training FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY d, fold_id, training ORDER BY {_h('i')}, p) / count(*) OVER (PARTITION BY d, fold_id, training)::DOUBLE AS place FROM g),
fo AS (SELECT p AS participant_label, d AS disease, CAST(fold_id AS INTEGER) AS fold_id, CASE WHEN NOT training THEN 'test' WHEN place > 1 - 1/3::DOUBLE THEN 'validation' WHEN place > (1 - 1/3::DOUBLE) * (1 - 1/3::DOUBLE) THEN 'train_smaller2' ELSE 'train_smaller1' END AS fold_label FROM o)"""


def _folds(spark, sf):
    return folds.assign_folds(rows(spark, sf, ["participant_label", "disease"]), "participant_label", "disease")


@query(sql(FOLD_SQL + " SELECT * FROM fo"))
def fold_assign(spark, sf):
    return folds.check_folds(_folds(spark, sf), "participant_label", 3)


@query(sql(FOLD_SQL + """, held AS (SELECT DISTINCT concat(fold_id, fold_label) AS o, cdr3_seq_aa_q_trim AS s, v_gene FROM fo JOIN r USING (participant_label) WHERE fold_id >= 0), n AS (SELECT o, count(*) AS n FROM held GROUP BY 1),
sh AS (SELECT a.o AS a, b.o AS b, count(*) AS shared FROM held a JOIN held b ON a.s = b.s AND a.v_gene = b.v_gene AND a.o < b.o GROUP BY 1, 2)
SELECT x.o AS a, y.o AS b, CAST(coalesce(shared, 0) AS BIGINT) AS shared, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0))::DOUBLE, 6) AS jaccard FROM n x JOIN n y ON x.o < y.o LEFT JOIN sh ON sh.a = x.o AND sh.b = y.o"""))
def fold_jaccard(spark, sf):
    f = _folds(spark, sf).where("fold_id >= 0").select("participant_label", F.concat(F.col("fold_id").cast("string"), "fold_label").alias("o"))
    held = rows(spark, sf, ["participant_label", "cdr3_seq_aa_q_trim", "v_gene"]).distinct().join(f, "participant_label")
    return rounded(folds.jaccard(held, ["cdr3_seq_aa_q_trim", "v_gene"], "o"), "jaccard")


@query(sql(""", held AS (SELECT DISTINCT participant_label AS o, cdr3_seq_aa_q_trim AS s, v_gene FROM r), n AS (SELECT o, count(*) AS n FROM held GROUP BY 1), sh AS (SELECT a.o AS a, b.o AS b, count(*) AS shared FROM held a JOIN held b ON a.s = b.s AND a.v_gene = b.v_gene AND a.o < b.o GROUP BY 1, 2)
SELECT x.o AS a, y.o AS b, CAST(coalesce(shared, 0) AS BIGINT) AS shared, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0))::DOUBLE, 6) AS jaccard FROM n x JOIN n y ON x.o < y.o LEFT JOIN sh ON sh.a = x.o AND sh.b = y.o"""))
def participant_jaccard(spark, sf):
    return rounded(folds.jaccard(rows(spark, sf, ["participant_label", "cdr3_seq_aa_q_trim", "v_gene"]), ["cdr3_seq_aa_q_trim", "v_gene"], "participant_label"), "jaccard")


@query(sql(FOLD_SQL + " SELECT fold_id, fold_label, disease, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT participant_label) AS BIGINT) AS participants FROM fo GROUP BY ALL"))
def fold_invariants(spark, sf):
    return _folds(spark, sf).groupBy("fold_id", "fold_label", "disease").agg(F.count("*").alias("n"), F.count_distinct("participant_label").alias("participants"))


@query("SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '0')), o_orderkey) <= 200")
def oversize_sample(spark, sf):
    return folds.capped(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 200, ["o_orderkey"])


@query(sql(f", pt AS ({_PART}) SELECT p AS participant_label, d AS disease, row_number() OVER (ORDER BY {_h()}, p) <= (SELECT count(*) FROM pt WHERE d = 'BUILDING') AS permuted FROM pt"))
def permute_labels(spark, sf):
    return folds.permuted_labels(rows(spark, sf, ["participant_label", "disease"]).distinct(), "participant_label", "disease", "BUILDING")


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '0')), o_orderkey LIMIT 500")
def random_sample(spark, sf):
    return folds.sampled(table(spark, sf, "orders").select("o_orderkey"), 500, ["o_orderkey"])


@query(sql(f", pt AS ({_PART}) SELECT p AS participant_label, d AS disease, CAST((row_number() OVER (PARTITION BY d ORDER BY {_h()}, p) - 1) % 5 AS INTEGER) AS inner_fold FROM pt"))
def inner_cv(spark, sf):
    df = rows(spark, sf, ["participant_label", "disease"]).distinct()
    return folds.inner_folds(df, "participant_label", "disease").select("participant_label", "disease", "inner_fold")


# Replicates, mutations, read-level operations.
@query("WITH x AS (SELECT l_partkey AS item, l_returnflag AS rep, count(*)::DOUBLE AS x FROM lineitem GROUP BY 1, 2), n AS (SELECT rep, sum(x) AS n FROM x GROUP BY 1) SELECT CAST((SELECT sum(a.x * b.x) FROM x a JOIN x b ON a.item = b.item AND a.rep < b.rep) AS DOUBLE) AS numerator, (SELECT sum(a.n * b.n) FROM n a JOIN n b ON a.rep < b.rep) AS denominator, round((SELECT sum(a.x * b.x) FROM x a JOIN x b ON a.item = b.item AND a.rep < b.rep) / (SELECT sum(a.n * b.n) FROM n a JOIN n b ON a.rep < b.rep), 9) AS score")
def coincidence_score(spark, sf):
    return rounded(legacy.coincidence(table(spark, sf, "lineitem"), "l_partkey", "l_returnflag"), "score", digits=9)


_GERM = "translate(md5(CAST(p_partkey % 50 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTAC-.')"


@query(f"SELECT p_type, CAST(i - 1 AS INTEGER) AS at, CAST(sum(CASE WHEN substr(q, i, 1) <> substr(g, i, 1) THEN 1 ELSE 0 END) AS BIGINT) AS mutated, CAST(count(*) AS BIGINT) AS compared FROM (SELECT p_type, {_DNA} AS q, {_GERM} AS g FROM part), generate_series(1, 32) s(i) WHERE substr(g, i, 1) IN ('A', 'C', 'G', 'T') GROUP BY 1, 2")
def mutation_track(spark, sf):
    germ = F.translate(F.md5((F.col("p_partkey") % 50).cast("string")), "0123456789abcdef", "ACGTACGTACGTAC-.")
    return legacy.mutation_track(table(spark, sf, "part").select("p_type", dna().alias("q"), germ.alias("g")), "q", "g", ["p_type"], 32)


@query("SELECT p_type, " + ", ".join(f"CAST(sum((SELECT count(*) FROM generate_series(1, 32) g(i) WHERE substr(s, CAST(i AS BIGINT), {len(m)}) = '{m}')) AS BIGINT) AS {m}" for m in ("AA", "AGC", "TA")) + f" FROM (SELECT p_type, {_DNA} AS s FROM part) GROUP BY 1")
def mutation_hotspots(spark, sf):
    return legacy.hotspots(table(spark, sf, "part").select("p_type", dna().alias("s")), "s", ["AA", "AGC", "TA"], ["p_type"])


@query(f"SELECT p_partkey, CASE WHEN contains(right(s, 10), 'ACG') THEN 'IGHG1' WHEN contains(right(s, 9), 'TT') THEN 'IGHA1' END AS isosubtype, substr(s, 1, 4) AS barcode, substr(s, 5, 24) AS inner_bases FROM (SELECT p_partkey, {_DNA} AS s FROM part)")
def isotype_calls(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", dna().alias("sequence"))
    called = legacy.isotype_call(df, [("ACG", "IGHG1"), ("TT", "IGHA1")], 7)
    return called.select("p_partkey", "isosubtype", F.substring("sequence", 1, 4).alias("barcode"), legacy.trimmed_of_barcode(F.col("sequence"), 0, 4).alias("inner_bases"))


@query(f"SELECT p_partkey, concat(f, '/', r) AS sample FROM (SELECT p_partkey, substr(s, 2, 2) AS f, substr(reverse(translate(s, 'ACGT', 'TGCA')), 2, 2) AS r FROM (SELECT p_partkey, {_DNA} AS s FROM part)) WHERE f IN ('AC', 'GT', 'TT') AND r IN ('CA', 'GG')")
def barcode_demux(spark, sf):
    pairs = spark.createDataFrame([(f, r, f"{f}/{r}") for f in ("AC", "GT", "TT") for r in ("CA", "GG")], "forward string, reverse string, sample string")
    return legacy.demultiplex(table(spark, sf, "part").select("p_partkey", dna().alias("sequence")), pairs, 1, 2).select("p_partkey", "sample")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def all_named_sets(spark, sf):
    c = table(spark, sf, "customer")
    sets = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("rich").alias("set_name")).union(c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("building")))
    chosen = legacy.select_by(table(spark, sf, "orders"), o_orderpriority=["1-URGENT", "2-HIGH"])
    return legacy.in_all_sets(chosen, sets, "o_custkey", ["rich", "building"]).select("o_orderkey")


@query(sql("SELECT " + ", ".join(f"CAST({'NULL' if f.name in ('amplification_label', 'disease_subtype') or f.name[:3] in ('fr1', 'fr2', 'fr3', 'pos') or f.name[:4] in ('cdr1', 'cdr2') or f.name in ('cdr3_aa_sequence_trim_len', 'total_clone_num_reads', 'num_clone_members') else f.name} AS {'VARCHAR' if f.dataType.simpleString() == 'string' else 'BIGINT' if f.dataType.simpleString() == 'bigint' else 'DOUBLE'}) AS {f.name}" if f.name != "isotype_supergroup" else "CASE WHEN isotype_supergroup IN ('IGHG', 'IGHA') THEN isotype_supergroup END AS isotype_supergroup" for f in SAMPLED) + " FROM r"))
def schema_enforce(spark, sf):
    names = ["participant_label", "specimen_label", "igh_or_tcrb_clone_id", "isotype_supergroup", "disease", "v_gene", "j_gene", "cdr3_seq_aa_q_trim", "v_mut", "num_reads", "study_name"]
    return enforce(rows(spark, sf, names), SAMPLED, {"isotype_supergroup": ["IGHG", "IGHA"]})
