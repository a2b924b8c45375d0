"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

from collections import Counter

import pytest

import corpus_pipeline
from sparkoire.llm import decontam, linededup, merkle, neardup, packing, quality, secrets, sharding, substring, suffix

from .conftest import CLASHES, edge_rows


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 1, 0), (7, 0, 1), (8, None, 0), (None, 1, 0), (3, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "The quick brown fox number 7 jumps over lazy dogs near"), (2, None), (3, ""), (4, "too short"), (None, "seven birds watch it from far away hills the quick brown fox")], "item_id long, text string")


def applied(name, df, labels, items):
    return {
        "near": lambda: neardup.near_duplicates(df), "substring": lambda: substring.remove_repeats(df), "quality": lambda: quality.classify(df, labels), "shard": lambda: sharding.shard(df),
        "merkle": lambda: merkle.fingerprints(df), "packing": lambda: packing.pack(df), "suffix": lambda: suffix.remove_repeats(df), "secrets": lambda: secrets.scan(df),
        "lines": lambda: linededup.line_dedup(df),
    }[name]()


NAMES = ["near", "substring", "quality", "shard", "merkle", "suffix", "secrets", "lines"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(name, edge, labels, items):
    got = Counter(r["doc_id"] for r in applied(name, edge, labels, items).collect())
    assert got == Counter(i for i, _ in edge_rows())


@pytest.mark.parametrize("name", [*NAMES, "packing"])
def test_empty_table(name, empty, labels, items):
    assert applied(name, empty, labels, items).count() == 0


def test_near_duplicates(edge):
    rows = {(r["doc_id"], r["n_shingles"]): r for r in neardup.near_duplicates(edge).collect()}
    assert rows[1, 0]["kept"] and rows[2, 0]["component_id"] == 2 and rows[3, 0]["kept"]
    assert {r["component_id"] for (i, _), r in rows.items() if i in (5, 6)} == {5}
    assert all(r["component_id"] is None and r["kept"] for (i, _), r in rows.items() if i is None)


def test_substrings(edge):
    rows = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(edge).collect()]
    assert ({r[1:] for r in rows if r[0] == 6}) == {(881, 880, "tail")}
    assert all(r[2] == 0 for r in rows if r[0] in (5, None))


def test_suffixes(edge):
    rows = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix.remove_repeats(edge).collect()]
    assert all(n == gone for i, n, gone in rows if i == 5) and all(gone == 0 for i, _, gone in rows if i in (2, 4, 7))


def test_decontamination(edge, empty, items):
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontam.contaminated(edge, items).collect()}
    assert {i for _, i in got} == {1, None} and {d for d, _ in got} == {5, 6, None} and set(got.values()) == {0}
    assert decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(edge, items.limit(0)).count() == 0
    kept = decontam.decontaminate(edge, items)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 7, 8, 9, 10, 11, None}


def test_short_items(spark):
    """Items of few words are found where they are equal, or within the edit that five words allow."""
    docs = spark.createDataFrame([(1, "a Red  fox ran"), (2, "the fox"), (3, "one two three four six"), (4, "日本語 x"), (5, "nothing of them"), (6, None)], "doc_id long, text string")
    few = spark.createDataFrame([(1, "red fox"), (2, "one two three four five"), (3, "日本語"), (4, "  ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_edits"]) for r in decontam.contaminated(docs, few).collect()}
    assert got == {(1, 1, 0), (3, 2, 1), (4, 3, 0)}
    assert {r["doc_id"] for r in decontam.decontaminate(docs, few).collect()} == {2, 5, 6}


def test_packing(edge):
    rows = packing.pack(edge, capacity=64, documents=4, attention=64.0 * 64).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in edge_rows())
    bins = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        filled, n, cost = bins.get(r["sequence_id"], (0, 0, 0))
        assert r["offset"] == filled
        bins[r["sequence_id"]] = (filled + r["length"], n + 1, cost + r["length"] ** 2)
    assert all(f <= 64 and n <= 4 and c <= 64 * 64 for f, n, c in bins.values())


def test_quality_without_both_classes(edge, labels):
    assert {r["score"] for r in quality.classify(edge, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in quality.classify(edge, labels.limit(0)).collect()} == {0.5}


def test_clashing_names_of_lines(edge):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        linededup.line_dedup(edge.withColumn("kept_text", F.lit(1)))
    assert set(CLASHES) < set(linededup.line_dedup(edge).columns)


def test_stages(spark, edge, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge.select(*columns), empty.select(*columns)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "packing" or docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
