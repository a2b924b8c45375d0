"""Specimen metadata: inclusion rules, label filters, derived labels, cleaning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import assert_none
from ..functions import vocab


@dataclass(frozen=True)
class Rule:
    """Which specimens a study design includes.

    A specimen's source must be allowed, its subtype or its disease must be, and
    its study must be among those included, if any are named, and not excluded.
    Refinements narrow single studies, then all.
    """

    sources: tuple[str, ...] = ()
    diseases: tuple[str, ...] = ()
    subtypes: tuple[str, ...] = ()
    studies: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    by_study: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    after: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def predicate(self) -> Column:
        keep = F.lit(True)
        if self.sources:
            keep = keep & F.col("data_source").isin(*self.sources)
        kinds = [F.col(c).isin(*names) for c, names in (("disease_subtype", self.subtypes), ("disease", self.diseases)) if names]
        if kinds:
            keep = keep & F.coalesce(reduce(lambda a, b: a | b, kinds), F.lit(False))
        if self.studies:
            keep = keep & F.col("study_name").isin(*self.studies)
        return keep & ~F.col("study_name").isin(*self.excluded) if self.excluded else keep

    def apply(self, specimens: DataFrame) -> DataFrame:
        out = specimens.where(self.predicate())
        if self.by_study:
            parts = [out.where(~F.col("study_name").isin(*self.by_study))] + [f(out.where(F.col("study_name") == s)) for s, f in self.by_study.items()]
            out = reduce(lambda a, b: a.unionByName(b), parts)
        return reduce(lambda df, f: f(df), self.after, out)


@dataclass(frozen=True)
class Target:
    """A label column and the rows that count for it."""

    label: str
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    where: Callable[[], Column] | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        keep = F.col(self.label).isNotNull()
        for column, values in self.allowed.items():
            keep = keep & F.col(column).isin(*values)
        for column in self.required:
            keep = keep & F.col(column).isNotNull()
        return rows.where(keep & self.where() if self.where else keep)

    def columns(self, wanted: list[str]) -> list[str]:
        return list(dict.fromkeys([*wanted, self.label]))


# Edges of the age bins.
AGE_EDGES = (0, 20, 30, 40, 50, 60, 70, 80, 100)


def age_groups(df: DataFrame, age: str = "age") -> DataFrame:
    """Age bins, left-closed; the oldest bin and ages outside are null, and so are the two-way groups then."""
    low_to_high = vocab.binned(age, AGE_EDGES[:-1])
    out = df.withColumn("age_group", F.when(F.col(age) < AGE_EDGES[-2], low_to_high))
    known = F.col("age_group").isNotNull()
    return out.withColumn("age_group_binary", F.when(known, F.when(F.col(age) < 50, "under 50").otherwise("50+"))).withColumn(
        "age_group_pediatric", F.when(known, F.when(F.col(age) < 18, "under 18").otherwise("18+"))
    )


def loci(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """List of loci whose flag is set, in the order given."""
    return df.withColumn("loci", F.filter(F.array(*[F.when(F.col(f), F.lit(name)) for name, f in flags.items()]), lambda x: x.isNotNull()))


def presence(df: DataFrame, locus: str) -> DataFrame:
    """has_BCR and has_TCR, exactly one of them true."""
    assert_none(df, ~F.col(locus).isin("BCR", "TCR"), "unknown locus")
    return df.withColumns({f"has_{x}": F.col(locus) == x for x in ("BCR", "TCR")})


def defaults(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Missing values from another column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.col(other)) for c, other in sources.items()})


def unique_labels(df: DataFrame, columns: list[str], study: str = "study_name") -> DataFrame:
    return df.withColumns({c: F.concat_ws("-", F.col(study), F.col(c)) for c in columns})


def exposure_labels(df: DataFrame, label: str = "disease") -> DataFrame:
    """Past exposure isn't known for any specimen; the label with its suffix and the rolled-up label follow."""
    exposed = df.withColumn("past_exposure", F.lit(False))
    suffix = F.when(F.col("past_exposure"), F.concat(F.col(label), F.lit(" (past exposure)"))).otherwise(F.col(label))
    return exposed.withColumn(f"{label}.separate_past_exposures", suffix).withColumn(f"{label}.rollup", F.col(label))


def names_target(df: DataFrame, positive: list[str], negative: str, target: str) -> DataFrame:
    """Rows whose positive texts name the target and whose negative text doesn't; nulls are blank, case doesn't count."""
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(target.lower())
    return df.where(reduce(lambda a, b: a | b, map(has, positive)) & ~has(negative))


def without_conflicts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct (keys, label), without keys that have several labels."""
    distinct = df.select(*keys, label).distinct()
    single = distinct.groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1")
    return distinct.join(single.drop("n"), keys, "left_semi")


def known_values(df: DataFrame, columns: list[str], placeholder: str = "ND") -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c) != placeholder for c in columns]))


def tags(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """A row for each distinct, trimmed, not blank tag."""
    pieces = F.array_distinct(F.transform(F.split(column, separator), F.trim))
    return df.withColumn("tag", F.explode(F.filter(pieces, lambda t: t != "")))


def specimens(rows: DataFrame, columns: list[str], key: str = "specimen_label") -> DataFrame:
    """Distinct metadata; several for one specimen raise."""
    from ..checks import assert_unique

    out = rows.select(key, *columns).distinct()
    assert_unique(out, [key], "specimen metadata")
    return out


def severity(df: DataFrame, subtype: str = "disease_subtype") -> DataFrame:
    """``disease_severity`` of the subtypes that tell one, null for others."""
    return df.withColumn("disease_severity", vocab.mapped(subtype, vocab.SEVERITIES, pass_through=False))


def one_per_cluster(rows: DataFrame, cluster: str, order: list, constants: dict[str, str], defaults_: dict[str, object]) -> DataFrame:
    """The first row of each cluster, with constant labels, and defaults where a column is missing or null."""
    from .windows import first_n

    first = first_n(rows, [cluster], order).withColumns({c: F.lit(v) for c, v in constants.items()})
    return first.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults_.items()})
