"""Whole rows of operators without a statement, and each pipeline stage on its own input, against plain computations."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkoire.llm import decontam, neardup, packing, quality

from . import plain
from .conftest import SF
from .test_lines import expected_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def items(spark):
    return dict(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect())


@pytest.fixture(scope="module")
def labels(spark):
    return dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())


def test_quality_rows(spark, corpus, labels):
    expected = plain.quality(corpus, labels)
    rows = quality.op3_quality_qda(spark, SF).collect()
    assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx(expected, abs=1e-6)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_decontamination_rows(spark, corpus, items):
    expected = plain.leaks(corpus, items)
    rows = decontam.op5_cgk_decontamination(spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_edits"] for r in rows} == expected
    for r in rows:
        stretch = plain.words(corpus[r["doc_id"]], True)[r["begin"] : r["end"]]
        item = plain.words(items[r["item_id"]], True)
        assert plain.fewest_edits(item, stretch) == r["n_edits"]


def test_words_of_documents_tokenize_alike():
    """All words of a thousand documents, one after the other, give the ids of the whole texts."""
    import duckdb

    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer, known = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall():
        assert known.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_likeness_follows_common_sentences(corpus):
    """Equal branches can't tell of more than the sentences in common, and of most of them."""
    from sparkoire.llm import merkle

    order = sorted(corpus)
    for a, b in zip(order, order[1:]):
        one, two = corpus[a], corpus[b]
        edited = one[: len(one) - len(one) // 4] + two[: len(one) // 4]
        got, most = merkle.likeness(merkle.build(one), merkle.build(edited)), plain.common_leaves(one, edited)
        assert got <= 1 and (one == edited) == (got == 1.0)
        if len(one) > 2000 and "\n" in one:
            assert got >= 0.5 * min(most, 0.75)


def test_stages_one_after_the_other(spark, corpus, items, labels):
    """Every stage's rows on what the one before it kept."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]

    def run(name, rows):
        return [tuple(r) for r in stages[name](spark, spark.createDataFrame(rows, SCHEMA), SF).collect()]

    scores = plain.quality({r[0]: r[1] for r in rows}, labels)
    kept = run("quality", rows)
    assert sorted(kept) == sorted(r for r in rows if scores[r[0]] >= 0.7)
    texts = {r[0]: r[1] for r in kept}
    gone = expected_lines(texts)
    left = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in texts.items()}
    lines = run("line_dedup", kept)
    touched = {d for d, _ in gone}
    assert {r[0]: r[1] for r in lines} == {d: t for d, t in left.items() if d not in touched or plain.words(t)}
    assert all(r[4] == len(r[1]) for r in lines if r[0] in touched)
    found = plain.components({r[0]: r[1] for r in lines})
    alone = run("near_duplicates", lines)
    assert sorted(alone) == sorted(r for r in lines if found[r[0]] == r[0])
    leaking = {d for d, _ in plain.leaks({r[0]: r[1] for r in alone}, items)}
    clean = run("decontamination", alone)
    assert leaking and sorted(clean) == sorted(r for r in alone if r[0] not in leaking)
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), defaultdict(list)
    bins = defaultdict(list)
    for doc, piece, start, length, crc, sequence, offset in run("packing", clean):
        pieces[doc].append((piece, start, length, crc))
        bins[sequence].append((offset, length))
    assert set(pieces) == {r[0] for r in clean}
    for r in clean:
        ids = np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        assert sorted(pieces[r[0]]) == [(k, at, min(4096, ids.size - at), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, ids.size, 4096))]
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_one_row_of_an_id(spark):
    """Of rows that share an id the least one stays, whatever their order."""
    rows = [(1, "b text of one", "en", "s", 1), (1, "a text of one", "en", "s", 1), (2, "another text", None, None, None)]
    for order in (rows, rows[::-1]):
        assert sorted(r["text"] for r in neardup.keep_one(spark.createDataFrame(order, SCHEMA)).collect()) == ["a text of one", "another text"]


def test_widely_held_values_are_copied(spark):
    """One owner's value in few repositories looks live, in many it is a copied example; of many owners too."""
    from sparkoire.llm import secrets

    rows = [(i, f"password = {v}") for i, v in enumerate(["fewplaces1"] * 3 + ["manyplaces2"] * 25)]
    df = spark.createDataFrame([(i, t, "one owner") for i, t in rows] + [(100 + i, "password = manyowners3", f"o{i}") for i in range(3)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in secrets.scan(df).collect()}
    assert got[0] == (1, 0) and got[5] == (0, 1) and got[100] == (0, 1)
