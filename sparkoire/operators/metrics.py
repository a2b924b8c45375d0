"""Scores of predictions and agreement of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(df: DataFrame, value: str, within: list[str], name: str = "rank") -> DataFrame:
    """Rank from 1, ties share their mean rank."""
    group = Window.partitionBy(*within)
    ties = Window.partitionBy(*within, value)
    return df.withColumn(name, F.rank().over(group.orderBy(value)) + (F.count("*").over(ties) - 1) / 2.0)


def mann_whitney(df: DataFrame, value: str, positive: Column, within: list[str]) -> DataFrame:
    """U of the positives, and a one-sided normal p-value (greater), for each group; AUROC is u / (n1 * n0)."""
    ranked = average_rank(df.withColumn("_p", positive.cast("long")), value, within)
    sums = ranked.groupBy(*within).agg(F.sum("_p").alias("n1"), F.sum(1 - F.col("_p")).alias("n0"), F.sum(F.col("rank") * F.col("_p")).alias("_r"))
    u = F.col("_r") - F.col("n1") * (F.col("n1") + 1) / 2
    out = sums.withColumn("u", u)
    z = (F.col("u") - F.col("n1") * F.col("n0") / 2) / F.nullif(F.sqrt(F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12), F.lit(0.0))
    return out.withColumn("z", z).withColumn("auroc", F.col("u") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0))).withColumn("p", normal_tail(F.col("z"))).drop("_r")


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by the continued fraction of its Mills ratio or its series."""
    a = F.abs(z)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("t"), a.alias("s")),
        lambda acc, k: F.struct((acc["t"] * a * a / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * a * a / (2 * k + 1)).alias("s")), lambda acc: acc["s"],
    )
    density = F.exp(-a * a / 2) / 2.5066282746310002
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, k: k / (a + f), lambda f: 1 / (a + f))
    upper = F.when(a < 4, 0.5 - density * series).otherwise(density * fraction)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def chi_square_tail(x: Column, df: int) -> Column:
    """Upper tail of the chi-square distribution with whole degrees of freedom."""
    half = x / 2
    if df % 2 == 0:
        terms = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, df // 2 - 1))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
                            lambda acc, k: F.struct((acc["t"] * half / k).alias("t"), (acc["s"] + acc["t"] * half / k).alias("s")), lambda acc: acc["s"]) if df > 2 else F.lit(1.0)
        return F.exp(-half) * terms
    base = 2 * normal_tail(F.sqrt(x))
    if df == 1:
        return base
    step = F.sqrt(2 * x / 3.141592653589793) * F.exp(-half)
    total, term = step, step
    for k in range(1, df // 2):
        term = term * x / (2 * k + 1)
        total = total + term
    return base + total


def confusion(df: DataFrame, true: str, predicted: str, labels: list[str], abstained: str = "Unknown") -> DataFrame:
    """Counts of predicted labels for each true one; no prediction is an outcome of its own."""
    outcome = F.coalesce(F.col(predicted), F.lit(abstained))
    return df.groupBy(true).agg(*[F.sum((outcome == x).cast("long")).alias(x) for x in (*labels, abstained)])


def agreement(df: DataFrame, a: str, b: str, within: list[str]) -> DataFrame:
    """Pearson, Spearman, root mean square error and Lin's concordance of two measurements."""
    ranked = average_rank(average_rank(df, a, within, "_ra"), b, within, "_rb")
    difference = F.col(a) - F.col(b)
    means = F.pow(F.avg(a) - F.avg(b), F.lit(2))
    return ranked.groupBy(*within).agg(
        F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"), F.sqrt(F.avg(difference * difference)).alias("rmse"),
        (2 * F.covar_pop(a, b) / (F.var_pop(a) + F.var_pop(b) + means)).alias("concordance"),
    )


def log_loss(df: DataFrame, true: str, classes: list[str], floor: float = 1e-15) -> DataFrame:
    p = F.coalesce(*[F.when(F.col(true) == c, F.col(c)) for c in classes])
    return df.agg((-F.avg(F.ln(F.greatest(p, F.lit(floor))))).alias("log_loss"))


def matthews(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Multi-class correlation coefficient from the counts of (true, predicted)."""
    counts = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    t, p = counts.groupBy("t").agg(F.sum("n").alias("x")), counts.groupBy("p").agg(F.sum("n").alias("y"))
    joint = t.join(p, F.col("t") == F.col("p"), "full").agg(
        F.sum(F.coalesce("x", F.lit(0.0)) * F.coalesce("y", F.lit(0.0))).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy")
    )
    all_ = counts.agg(F.sum("n").alias("s"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0)).alias("c"))
    s2 = F.col("s") * F.col("s")
    return joint.crossJoin(all_).select(((F.col("c") * F.col("s") - F.col("xy")) / F.nullif(F.sqrt((s2 - F.col("xx")) * (s2 - F.col("yy"))), F.lit(0.0))).alias("mcc"))


def bootstrap(rows: DataFrame, ids: list[str], value: str, rounds: int, size: int) -> DataFrame:
    """Mean of ``size`` rows for each round, chosen by hash order."""
    drawn = rows.select(*ids, value).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    order = Window.partitionBy("round").orderBy(F.md5(F.concat_ws("|", *[F.col(i).cast("string") for i in ids], F.col("round").cast("string"))), *ids)
    return drawn.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).groupBy("round").agg(F.avg(value).alias("mean"))


def roc(df: DataFrame, score: str, positive: Column, within: list[str]) -> DataFrame:
    """(within, threshold, false_positive_rate, true_positive_rate): a point for each distinct score, the highest first."""
    counts = df.groupBy(*within, F.col(score).alias("threshold")).agg(F.sum(positive.cast("long")).alias("_p"), F.sum((~positive).cast("long")).alias("_n"))
    upto, whole = Window.partitionBy(*within).orderBy(F.col("threshold").desc()), Window.partitionBy(*within)
    rate = lambda c: F.sum(c).over(upto) / F.nullif(F.sum(c).over(whole), F.lit(0))
    return counts.select(*within, "threshold", rate("_n").alias("false_positive_rate"), rate("_p").alias("true_positive_rate"))


def pairwise_auroc(df: DataFrame, true: str, classes: list[str]) -> DataFrame:
    """(a, b, auroc, share) for each pair of classes: the mean of a's AUROC by its score and b's by its own, among rows of both; and those rows' share of all."""
    pairs = [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]
    sides = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("side"), F.col(f"`{c}`").alias("score"), (F.col(true) == c).alias("hit"), F.col(true).isin(a, b).alias("own")) for a, b in pairs for c in (a, b)]
    long = df.select(F.explode(F.array(*sides)).alias("x")).select("x.*")
    tested = mann_whitney(long.where("own"), "score", F.col("hit"), ["a", "b", "side"])
    rows = df.where(F.col(true).isin(*classes)).agg(F.count("*").alias("_all"))
    per_pair = tested.groupBy("a", "b").agg(F.avg("auroc").alias("auroc"), F.max(F.col("n1") + F.col("n0")).alias("_own"))
    return per_pair.crossJoin(F.broadcast(rows)).select("a", "b", "auroc", (F.col("_own") / F.col("_all")).alias("share"))


def one_vs_one_auroc(df: DataFrame, true: str, classes: list[str]) -> DataFrame:
    """The pairs' AUROC as one number, plain and weighted by the pairs' shares."""
    pairs = pairwise_auroc(df, true, classes)
    return pairs.agg(F.avg("auroc").alias("auroc"), (F.sum(F.col("auroc") * F.col("share")) / F.sum("share")).alias("weighted_auroc"))


def detection(df: DataFrame, positive: Column, predicted: Column, within: list[str]) -> DataFrame:
    """Sensitivity and specificity of each group."""
    count = lambda c: F.sum(c.cast("long"))
    return df.groupBy(*within).agg((count(positive & predicted) / F.nullif(count(positive), F.lit(0))).alias("sensitivity"), (count(~positive & ~predicted) / F.nullif(count(~positive), F.lit(0))).alias("specificity"))


def mean_over_folds(per_fold: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Mean and sample standard deviation over folds."""
    return per_fold.groupBy(*group).agg(*[F.avg(v).alias(f"{v}_mean") for v in values], *[F.stddev_samp(v).alias(f"{v}_std") for v in values])


def length_weighted(losses: DataFrame, loss: str, weight: str, group: list[str]) -> DataFrame:
    """Mean loss weighted by the rows that each loss stands for."""
    return losses.groupBy(*group).agg((F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)).alias("mean"))


def average_precision(df: DataFrame, score: str, positive: Column, within: list[str], ties: list[str]) -> DataFrame:
    """Mean precision at the positives, the highest score first; ties go by the given columns."""
    order = Window.partitionBy(*within).orderBy(F.col(score).desc(), *ties)
    ranked = df.withColumn("_hit", positive.cast("long")).withColumn("_rank", F.row_number().over(order)).withColumn("_seen", F.sum("_hit").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.groupBy(*within).agg(F.avg(F.when(F.col("_hit") == 1, F.col("_seen") / F.col("_rank"))).alias("auprc"), F.avg("_hit").alias("prevalence"))


def precision_permutation(df: DataFrame, score: str, positive: Column, within: list[str], ties: list[str], rounds: int = 1000) -> DataFrame:
    """(within, auprc, fold_change, p): whether average precision over prevalence beats that of labels permuted by hash order.

    Each round permutes the labels within the group: as many rows as are positive,
    by hash order of ties and round, become positive.
    """
    flagged = df.withColumn("_positive", positive.cast("long"))
    observed = average_precision(flagged, score, F.col("_positive") == 1, within, ties)
    every = flagged.withColumn("_n", F.sum("_positive").over(Window.partitionBy(*within))).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    shuffled = Window.partitionBy(*within, "_round").orderBy(F.md5(F.concat_ws("|", *[F.col(t).cast("string") for t in ties], F.col("_round").cast("string"))), *ties)
    drawn = every.withColumn("_drawn", F.row_number().over(shuffled) <= F.col("_n"))
    null = average_precision(drawn, score, F.col("_drawn"), [*within, "_round"], ties).select(*within, F.col("auprc").alias("_null"))
    joined = observed.join(null, within)
    return joined.groupBy(*within, "auprc", "prevalence").agg(((F.sum((F.col("_null") >= F.col("auprc")).cast("long")) + 1) / (F.count("*") + 1)).alias("p")).select(
        *within, "auprc", (F.col("auprc") / F.nullif(F.col("prevalence"), F.lit(0.0))).alias("fold_change"), "p"
    )


def likelihood_ratio(df: DataFrame, reduced: str, full: str, freedom: int) -> DataFrame:
    """The rows with ``statistic`` 2 (full - reduced) of log-likelihoods and its chi-square tail ``p``."""
    statistic = F.greatest(2 * (F.col(full) - F.col(reduced)), F.lit(0.0))
    return df.withColumn("statistic", statistic).withColumn("p", chi_square_tail(F.col("statistic"), freedom))


def threshold_scores(df: DataFrame, score: str, positive: Column, candidates: list[float]) -> DataFrame:
    """(threshold, mcc, best) of a grid, from one aggregate; of equal ones the first is best."""
    count = lambda c: F.sum(c.cast("double"))
    cells = []
    for i, t in enumerate(candidates):
        said = F.col(score) >= t
        cells += [count(positive & said).alias(f"a{i}"), count(~positive & said).alias(f"b{i}"), count(positive & ~said).alias(f"c{i}"), count(~positive & ~said).alias(f"d{i}")]
    row = lambda i, t: F.struct(F.lit(float(t)).alias("threshold"), F.lit(i).alias("_i"), *[F.col(f"{x}{i}").alias(x) for x in "abcd"])
    grid = df.agg(*cells).select(F.explode(F.array(*[row(i, t) for i, t in enumerate(candidates)])).alias("g")).select("g.*")
    a, b, c, d = (F.col(x) for x in "abcd")
    scored = grid.withColumn("mcc", F.coalesce((a * d - b * c) / F.nullif(F.sqrt((a + b) * (a + c) * (d + b) * (d + c)), F.lit(0.0)), F.lit(0.0)))
    top = Window.orderBy(F.col("mcc").desc(), "_i")  # a row for each candidate
    return scored.select("threshold", "mcc", (F.row_number().over(top) == 1).alias("best"))
