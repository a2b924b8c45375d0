"""Column builders for sequences, genes and regions; all stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The amino-acid alphabet, hydropathy index and charges of residues.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
POSITIVE, NEGATIVE = "KR", "DE"
# The standard genetic code, bases in the order T C A G.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: GENETIC_CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(s: Column) -> Column:
    return F.when(s != "", s)


def trim_sequence(s) -> Column:
    """Without dots, dashes, stars and spaces, in capitals; blank is null."""
    return blank_to_null(F.upper(F.trim(F.translate(col(s), ".- *", ""))))


def strip_ends(s) -> Column:
    """Without the first and last residue; fewer than three leave null."""
    s = col(s)
    return F.when(F.length(s) > 2, F.substring(s, F.lit(2), F.length(s) - 2))


def without_prefix(s, prefix) -> Column:
    """s without the prefix if it begins with it, else unchanged."""
    s, prefix = col(s), col(prefix)
    return F.when(F.startswith(s, prefix), blank_to_null(F.substring(s, F.length(prefix) + 1, F.length(s)))).otherwise(s)


def valid_residues(s) -> Column:
    return col(s).rlike(f"^[{AMINO_ACIDS}]+$")


def gene(allele) -> Column:
    """Before the star; a suffix in parentheses goes too."""
    return F.trim(F.substring_index(F.substring_index(col(allele), "*", 1), "(", 1))


def v_family(v) -> Column:
    """Before the first dash, then before the first slash; blank or null raises."""
    v = col(v)
    family = F.substring_index(F.substring_index(v, "-", 1), "/", 1)
    return F.when(F.coalesce(F.trim(v), F.lit("")) == "", F.raise_error(F.lit("blank V gene")).cast("string")).otherwise(family)


def mutation_rate(s) -> Column:
    """Share of capitals; null for an empty sequence."""
    s = col(s)
    return F.length(F.regexp_replace(s, "[^A-Z]", "")) / F.nullif(F.length(s), F.lit(0))


def heavy_name(v) -> Column:
    return F.regexp_replace(col(v), "^Ig", "IGH")


def joined_regions(*regions) -> Column:
    """Concatenation with null as blank."""
    return F.concat_ws("", *[F.coalesce(col(r), F.lit("")) for r in regions])


def mask_query(query, germline) -> Column:
    """The part of the query between the germline's leading and trailing gaps."""
    query, germline = col(query), col(germline)
    lead = F.length(germline) - F.length(F.regexp_replace(germline, "^[.-]+", ""))
    tail = F.length(germline) - F.length(F.regexp_replace(germline, "[.-]+$", ""))
    return F.substring(query, lead + 1, F.greatest(F.length(query) - lead - tail, F.lit(0)))


def residues(s) -> Column:
    return F.split(col(s), "")


def hamming(a, b) -> Column:
    """Places that differ, of equal lengths; null otherwise."""
    a, b = col(a), col(b)
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.zip_with(residues(a), residues(b), lambda x, y: x != y), lambda x: x)))


def normalised_hamming(a, b) -> Column:
    return hamming(a, b) / F.length(col(a))


def mutation_marks(query, germline) -> Column:
    """Query in lower case, capitals where it differs from a germline base."""
    same = lambda q, g: F.when((F.upper(q) == F.upper(g)) | g.isin("-", ".", "N", "n"), F.lower(q)).otherwise(F.upper(q))
    return F.array_join(F.zip_with(residues(query), residues(germline), same), "")


def insertions(germline) -> Column:
    """Gaps in the germline are bases inserted into the query."""
    return F.length(col(germline)) - F.length(F.replace(col(germline), F.lit("-"), F.lit("")))


deletions = insertions


def rightmost_motif(s, motifs: tuple[str, ...]) -> Column:
    """Zero-based place of the last match, overlapping ones too, of the first motif that is found; else -1."""
    s = col(s)
    def last(m):
        ahead = F.regexp_extract_all(s, F.lit(f"(?s)(?=({m}.*))"), F.lit(1))
        return F.when(F.size(ahead) > 0, F.length(s) - F.length(F.element_at(ahead, -1)))
    return F.coalesce(*[last(m) for m in motifs], F.lit(-1))


def translate_codons(s) -> Column:
    """Residues of a nucleotide sequence without gaps; unknown codons are X, an incomplete one is left out."""
    bases = F.upper(F.regexp_replace(col(s), "[.-]", ""))
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    n = F.floor(F.length(bases) / 3).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.coalesce(F.try_element_at(table, F.substring(bases, i * 3 + 1, F.lit(3))), F.lit("X"))), "")


def reverse_complement(s) -> Column:
    return F.reverse(F.translate(col(s), "ACGTacgt", "TGCAtgca"))


def count_residues(s, letters: str) -> Column:
    s = col(s)
    return F.length(s) - F.length(F.translate(s, letters, ""))


def charge(s) -> Column:
    return count_residues(s, POSITIVE) - count_residues(s, NEGATIVE)


def hydropathy(s) -> Column:
    """Mean over residues; stars, X and other letters don't count."""
    s = col(s)
    total = reduce(lambda a, b: a + b, [count_residues(s, r) * F.lit(v) for r, v in HYDROPATHY.items()])
    return total / F.nullif(count_residues(s, AMINO_ACIDS), F.lit(0))


def insert_gaps(s, template) -> Column:
    """Letters of s into the places of the template that aren't dots."""
    s, template = col(s), col(template)
    cells = residues(template)
    filled = F.transform(cells, lambda c, i: F.when(c == ".", F.lit(".")).otherwise(F.substring(s, F.size(F.filter(F.slice(cells, F.lit(1), i + 1), lambda x: x != ".")), F.lit(1))))
    return F.array_join(filled, "")


def remove_double_gaps(a, b) -> tuple[Column, Column]:
    """Both aligned strings without the places where both have a gap."""
    pairs = F.filter(F.arrays_zip(residues(a).alias("x"), residues(b).alias("y")), lambda p: ~((p["x"] == "-") & (p["y"] == "-")))
    return F.array_join(F.transform(pairs, lambda p: p["x"]), ""), F.array_join(F.transform(pairs, lambda p: p["y"]), "")


def natural_key(s, width: int = 8) -> Column:
    """Sorts names by their numbers: digits are padded to one width."""
    parts = F.regexp_extract_all(col(s), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(p)), "")


def slug(s) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(s))), "[^a-z0-9]+", "-"), "^-|-$", "")


def kmers(s, k: int) -> Column:
    s = col(s)
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
