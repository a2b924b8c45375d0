"""Document fingerprints: Merkle trees over sections, paragraphs and stretches of sentences."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Most characters of a leaf, by the place in its paragraph: short near the front, so that short texts have some.
FRONT = ((24, 6), (96, 12), (256, 32))
LEAF = 96
#: A section ends behind a paragraph whose digest is 0 modulo this, so sections come back into step behind an edit.
SECTION = 8
SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass
class Section:
    """Digest and characters; its paragraphs, each as its leaves' digests and lengths in hex."""

    digest: str
    size: int
    paragraphs: list[str]


@dataclass
class Tree:
    root: str
    sections: list[Section]

    def __str__(self) -> str:
        """root:section(paragraph,paragraph)section(...); a paragraph lists 8 hex digits of digest and 2 of length for each leaf."""
        return self.root + ":" + "".join(f"{s.digest}({','.join(s.paragraphs)})" for s in self.sections)


def leaves(paragraph: str) -> list[str]:
    """Sentences, the longer ones cut."""
    out, at = [], 0
    for sentence in SENTENCE.findall(paragraph):
        end = at + len(sentence)
        while at < end:
            width = next((w for before, w in FRONT if at < before), LEAF)
            cut = min(end, at + width)
            out.append(paragraph[at:cut])
            at = cut
    return out


def build(text: str) -> Tree:
    """The tree of a text.  Lines are paragraphs; the root is the digest of the sections' digests, those of their paragraphs' and so on.

    An empty text has one empty paragraph.
    """
    sections, below, written, size = [], [], [], 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        parts = leaves(line)
        own = [digest(p.encode("utf-8", "surrogatepass")) for p in parts]
        node = digest(b"".join(own))
        below.append(node)
        written.append("".join(f"{d[:4].hex()}{len(p):02x}" for d, p in zip(own, parts, strict=True)))
        size += len(line)
        if node[0] % SECTION == 0 or k == len(lines) - 1:
            sections.append((digest(b"".join(below)), Section("", size, written)))
            below, written, size = [], [], 0
    for d, s in sections:
        s.digest = d[:8].hex()
    return Tree(digest(b"".join(d for d, _ in sections)).hex(), [s for _, s in sections])


def parse(fingerprint: str) -> Tree:
    root, _, rest = fingerprint.partition(":")
    sections = []
    for name, body in re.findall(r"([0-9a-f]+)\(([^)]*)\)", rest):
        paragraphs = body.split(",")
        sections.append(Section(name, sum(weight(p) for p in paragraphs), paragraphs))
    return Tree(root, sections)


def cells(paragraph: str) -> list[str]:
    return [paragraph[i : i + 10] for i in range(0, len(paragraph), 10)]


def weight(paragraph: str) -> int:
    return sum(int(paragraph[i : i + 2], 16) for i in range(8, len(paragraph), 10))


def likeness(a: Tree, b: Tree) -> float:
    """Share of characters in branches that both trees have, 0 to 1; 1 if the roots are equal, 0 if just one text is empty.

    Equal sections count whole; what is left is compared paragraph by paragraph
    and, where those differ, leaf by leaf.
    """
    if a.root == b.root:
        return 1.0
    total = sum(s.size for s in a.sections) + sum(s.size for s in b.sections)
    sections = Counter(s.digest for s in a.sections) & Counter(s.digest for s in b.sections)
    same = 0
    rest: list[Counter] = []
    for tree in (a, b):
        todo, left = sections.copy(), Counter()
        for s in tree.sections:
            if todo[s.digest]:
                todo[s.digest] -= 1
                same += s.size if tree is a else 0
            else:
                left.update(s.paragraphs)
        rest.append(left)
    both = rest[0] & rest[1]
    same += sum(weight(p) * n for p, n in both.items())
    fine = [Counter(), Counter()]
    for side, left in zip(fine, rest, strict=True):
        for p, n in (left - both).items():
            for c in cells(p):
                side[c] += n
    same += sum(int(c[8:], 16) * n for c, n in (fine[0] & fine[1]).items())
    return min(1.0, 2 * same / total) if total else 0.0


def changes(a: str, b: str) -> list[tuple[int, int, int]]:
    """(paragraph, begin, end) of the stretches of fingerprint a's text that b's text lacks, found by descending into differing branches."""
    x, y = parse(a), parse(b)
    if x.root == y.root:
        return []
    same = Counter(s.digest for s in x.sections) & Counter(s.digest for s in y.sections)

    def rest(tree: Tree) -> list[tuple[int, str]]:
        """(number, paragraph) of the sections that the other tree lacks."""
        todo, out, number = same.copy(), [], 0
        for s in tree.sections:
            if todo[s.digest]:
                todo[s.digest] -= 1
            else:
                out += [(number + k, p) for k, p in enumerate(s.paragraphs)]
            number += len(s.paragraphs)
        return out

    mine, theirs = rest(x), rest(y)
    shared = Counter(p for _, p in mine) & Counter(p for _, p in theirs)
    left = Counter(p for _, p in theirs) - shared
    stretches = Counter(c for p, n in left.items() for c in cells(p) for _ in range(n))
    out = []
    for number, p in mine:
        if shared[p]:
            shared[p] -= 1
            continue
        at = 0
        for c in cells(p):
            end = at + int(c[8:], 16)
            if stretches[c]:
                stretches[c] -= 1
            else:
                out.append((number, at, end))
            at = end
    return out


def ranges(scratch: common.Scratch, keys: DataFrame, n: int) -> list[tuple]:
    """First (doc_id, hash) of each of at most n ranges of ids, in order; one row for each range comes to the driver."""
    order = [F.col("doc_id").asc_nulls_first()]
    pieces = keys.where(F.col("doc_id").isNotNull()).repartitionByRange(n, *order).select("doc_id", F.spark_partition_id().alias("piece"))
    firsts = sorted({r[1] for r in pieces.groupBy("piece").agg(F.min("doc_id")).collect()})
    low = keys.where(F.col("doc_id").isin(firsts) if firsts else F.lit(False)).groupBy("doc_id").agg(F.min("hash").alias("hash")).collect()
    return sorted((r[0], r[1]) for r in low)


def place(doc_id: Column, firsts: list) -> Column:
    """Number of the range that an id is in; two looks into lists of about the square root of their number."""
    if not firsts:
        return F.lit(0)
    step = max(1, round(len(firsts) ** 0.5))
    fine = F.array(*[F.array(*[F.lit(x) for x in firsts[i : i + step]]) for i in range(0, len(firsts), step)])
    coarse = F.array(*[F.lit(x) for x in firsts[::step]])
    k = F.greatest(F.lit(0), F.size(F.filter(coarse, lambda x: x <= doc_id)) - 1)
    inside = F.greatest(F.lit(0), F.size(F.filter(F.get(fine, k), lambda x: x <= doc_id)) - 1)
    return F.when(doc_id.isNull(), 0).otherwise(k * step + inside)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 4) characters replaced by the
    first as many (or all) of the next document's text, in ascending order of id
    and then of the text's md5; after the last comes the first.

    Texts are dealt by ranges of ids once.  The first document of each range is
    also sent to the range before it, so that every document meets its next one.

    Null texts count as empty ones.  Null ids sort first.  Repeated rows follow
    each other.  A single row is its own next.  An empty table gives an empty
    result.  Further columns aren't read.
    """
    spark = df.sparkSession
    scratch = common.Scratch(spark, "merkle")
    texts = common.ids_and_text(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.md5("text"))
    keys = scratch.cut(texts.select("doc_id", "hash"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = ranges(scratch, keys, 4 * n)
    ids = [x[0] for x in firsts]
    null_first = keys.where(F.col("doc_id").isNull()).agg(F.min("hash")).first()[0]
    at = place(F.col("doc_id"), ids)
    # Firsts of ranges; null ids, if there are any, come before range 0 and lead it.
    leads = F.lit(False)
    for_range = F.array(*[F.lit(x[1]) for x in firsts]) if firsts else F.array(F.lit(""))
    lead_ids = F.array(*[F.lit(x) for x in ids]) if ids else None
    if ids:
        leads = (F.get(lead_ids, F.col("at")) == F.col("doc_id")) & (F.get(for_range, F.col("at")) == F.col("hash"))
    if null_first is not None:
        leads = F.when(F.col("at") == 0, F.col("doc_id").isNull() & (F.col("hash") == null_first)).otherwise(leads)
    last = max(0, len(ids) - 1)
    guest = F.struct(F.when(F.col("at") == 0, last).otherwise(F.col("at") - 1).alias("at"), F.lit(True).alias("guest"))
    own = F.struct(F.col("at"), F.lit(False).alias("guest"))
    dealt = (
        texts.withColumn("at", at)
        .withColumn("to", F.explode(F.when(F.coalesce(leads, F.lit(False)), F.array(own, guest)).otherwise(F.array(own))))
        .select("doc_id", "text", "hash", F.col("to.at").alias("at"), F.col("to.guest").alias("guest"))
        .repartition(n, "at").sortWithinPartitions("at", "guest", F.col("doc_id").asc_nulls_first(), "hash")
    )
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        waiting = None  # (range, id, text, tree) of the row before
        for b in batches:
            ids, rows = [], []
            for doc, text, range_no, is_guest in zip(*(b.column(c) for c in ("doc_id", "text", "at", "guest")), strict=True):
                text, range_no, is_guest = text.as_py(), range_no.as_py(), is_guest.as_py()
                tree = build(text)
                if waiting and waiting[0] == range_no:
                    _, before, old, old_tree = waiting
                    cut = len(old) // 4
                    edited = old[: len(old) - cut] + text[:cut]
                    edited_tree = build(edited)
                    ids.append(before)
                    rows.append((len(old), hashlib.sha256(edited.encode()).hexdigest(), str(old_tree), str(edited_tree), likeness(old_tree, edited_tree), likeness(old_tree, tree)))
                waiting = None if is_guest else (range_no, doc, text, tree)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], b.schema.field("doc_id").type), *map(pa.array, columns, kinds)], ["doc_id", *names])

    return dealt.select("doc_id", "text", "at", "guest").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))
