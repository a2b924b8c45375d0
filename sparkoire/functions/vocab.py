"""Column builders for labels: maps, bins, one-hot vocabularies, interactions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import col

# Isotypes by supergroup, the groups kept, thresholds of the data model, severities of subtypes.
ISOTYPE_GROUPS = {
    "IGHA": ("IGHA", "IGHA1", "IGHA2"), "IGHD-M": ("IGHD", "IGHM"), "IGHE": ("IGHE",),
    "IGHG": ("IGHG", "IGHG1", "IGHG2", "IGHG3", "IGHG4"), "TCRB": ("TCRB", "TRBC1", "TRBC2"),
}
ISOTYPES_KEPT = {"BCR": ("IGHG", "IGHA", "IGHD-M"), "TCR": ("TCRB",)}
CLONES_REQUIRED = {"IGHG": 100, "IGHA": 100, "IGHD-M": 500, "TCRB": 500}
V_SCORE_ABOVE = {"BCR": 200.0, "TCR": 80.0}
SEVERITIES = {
    "Covid19 - Sero-negative (ICU)": "ICU", "Covid19 - Sero-positive (ICU)": "ICU",
    "Covid19 - Sero-negative (Admit)": "Admit", "Covid19 - Sero-positive (Admit)": "Admit",
    "Covid19 - Admit": "Admit", "Covid19 - ICU": "ICU",
    "Pediatric SLE - nephritis": "Nephritis", "Pediatric SLE - no nephritis": "No nephritis",
    "SLE Multiple aAbs / SLE dsDNA WITH Nephritis": "Nephritis", "SLE Multiple aAbs / SLE dsDNA WITHOUT Nephritis": "No nephritis",
    "SLE One aAbs / SLE dsDNA WITH Nephritis": "Nephritis", "SLE One aAbs / SLE dsDNA WITHOUT Nephritis": "No nephritis",
}
MIN_CDR3, MIN_ROWS, MUTATED_FROM = 8, 1000, 0.01
V_RENAMES = {"TRBV12-4": "TRBV12-3", "TRBV6-3": "TRBV6-2"}


def mapped(c, values: dict, pass_through: bool = True) -> Column:
    """Values by a map; unmapped ones stay or become null."""
    c = col(c)
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, c)
    return F.coalesce(found, c) if pass_through else found


def required(c: Column, source, what: str) -> Column:
    """c, unless it is null where the source isn't: that raises."""
    source = col(source)
    bad = c.isNull() & source.isNotNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"unknown {what}: "), source.cast("string"))).cast("string")).otherwise(c)


def isotype_supergroup(c) -> Column:
    c = col(c)
    exact = mapped(c, {x: group for group, names in ISOTYPE_GROUPS.items() for x in names}, pass_through=False)
    return F.coalesce(exact, F.when(c.startswith("multi"), "IGHG"), F.when(c == "gDNA", "gDNA"))


def day_of(time_point) -> Column:
    """First integer of texts that speak of a day; 00:00:00 is day 0."""
    t = col(time_point)
    return F.when(t == "00:00:00", 0).when(F.lower(t).contains("day"), F.regexp_extract(t, "-?[0-9]+", 0).try_cast("int"))


def binned(x, edges: Iterable[float], suffix: str = "") -> Column:
    """Left-closed bins "a-b"; null outside."""
    x, edges = col(x), list(edges)
    out = None
    for low, high in zip(edges, edges[1:]):
        hit, label = (x >= low) & (x < high), F.lit(f"{low}-{high}{suffix}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def first_suffix(c, categories: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Category of the first suffix that fits."""
    out = F.lit(otherwise)
    for suffix, name in reversed(categories):
        out = F.when(F.endswith(col(c), F.lit(suffix)), name).otherwise(out)
    return out


def one_hot(c, values: list[str], prefix: str, drop_first: bool = False) -> list[Column]:
    """A column for each value in order; null gives zeros, an unknown value raises."""
    known = required(F.when(col(c).isin(*values), col(c)), c, "category")
    return [F.when(known == v, 1.0).otherwise(0.0).alias(f"{prefix}{v}") for v in values[drop_first:]]


def expand(patterns: Iterable[str], columns: list[str]) -> list[str]:
    """Column names that fit patterns with stars, in column order."""
    return [c for c in columns if any(fnmatch(c, p) for p in patterns)]


def interactions(left: list[str], right: list[str], keep: Callable[[str, str], bool] = lambda a, b: True) -> list[Column]:
    """Products of unordered pairs, each once, none with itself."""
    seen, out = set(), []
    for a in left:
        for b in right:
            pair = frozenset((a, b))
            if a != b and pair not in seen and keep(a, b):
                seen.add(pair)
                out.append((F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{a}:{b}"))
    return out


def overridden(df: DataFrame, columns: list[str], suffix: str = "_override") -> DataFrame:
    """Columns take their override where there is one; overrides are dropped."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c + suffix), F.col(c))).drop(c + suffix)
    return df


def matches_nullable(flag: Column) -> Column:
    """A filter that keeps rows for which the condition is unknown."""
    return F.coalesce(flag, F.lit(True))
