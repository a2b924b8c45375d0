"""Whole results against SQL, brute force, exact round trips and held-out labels."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkoire.llm import common, decontam, linededup, merkle, neardup, packing, quality, queries, sharding, suffix, textops

from .conftest import SF, frame


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_statement(spark, name):
    got, expected = same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)
    assert got == expected


def test_permutation_is_a_bijection():
    for n in (1, 2, 5, 1000, 4097):
        assert sorted(sharding.permute(np.arange(n), n, 3).tolist()) == list(range(n))
    assert sharding.permute(np.arange(0), 0, 3).size == 0


def test_shards(spark, corpus):
    rows = sharding.op4_feistel_shards(spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["size"] == len(corpus[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(corpus[r["doc_id"]].encode())
    sizes = [len(v) for v in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_pruning_bounds_follow_the_posterior():
    """P(Beta(m + 1, n - m + 1) >= t), summed numerically, is below the miss probability one match lower and not below it there."""
    def tail(m, n, t):
        x = np.linspace(0, 1, 200_001)[1:-1]
        log = m * np.log(x) + (n - m) * np.log(1 - x)
        w = np.exp(log - log.max())
        return w[x >= t].sum() / w.sum()

    for k, least in enumerate(neardup.least_matches(0.75, 1e-6)):
        n = (k + 1) * neardup.BATCH
        assert tail(least, n, 0.75) >= 1e-6 * 0.99 and (least == 0 or tail(least - 1, n, 0.75) < 1e-6 * 1.01)


def test_large_group_of_near_copies(spark):
    """Links are found though members only resemble each other in chains, beyond a block and a star."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: find(i) for i in sets}


def test_suffix_array():
    rng = random.Random(1)
    for n in [*range(30), 300]:
        for k in (1, 2, 5):
            s = np.array([rng.randint(1, k) for _ in range(n)], np.int64)
            assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("hot", [10**9, 4000])
def test_splits_of_large_anchors(spark, monkeypatch, hot):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefg ") for _ in range(900))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(60 + i)) + passage[: 500 + 9 * i] + "".join(rng.choice("xyz ") for _ in range(70))) for i in range(40)]
    monkeypatch.setattr(suffix, "PART", 2000)
    monkeypatch.setattr(suffix, "HOT", hot)
    seen = defaultdict(int)
    for _, t in rows:
        for k in range(len(t) - 399):
            seen[t[k : k + 400]] += 1
    for r in suffix.remove_repeats(frame(spark, rows)).collect():
        t = dict(rows)[r["doc_id"]]
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                mask[k : k + 400] = True
        assert r["n_removed"] == mask.sum() and bytes(r["kept"]) == bytes(b for b, m in zip(t.encode(), mask) if not m)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scores = quality.op3_quality_qda(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in scores)
    assert len(scores) > 60 and right / len(scores) >= 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = common.documents(spark, SF)
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_recall_at_the_edit_bound():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 60))).encode() for _ in range(30)]
    index, tables = decontam.Index(items), textops.Tables()
    found = total = 0
    for _ in range(10):
        for i, item in enumerate(items):
            words = item.decode().split()
            for _ in range(index.edits(len(words))):
                p, kind = rng.randrange(len(words)), rng.random()
                if kind < 0.34:
                    words[p] = rng.choice(vocabulary)
                elif kind < 0.67:
                    words.insert(p, rng.choice(vocabulary))
                else:
                    del words[p]
            noise = [rng.choice(vocabulary) for _ in range(80)]
            hashes, _, _, _ = textops.words([" ".join(noise[:40] + words + noise[40:]).encode()], tables, True)
            found += (0, i) in index.leaks([hashes], [index.seeds(hashes)])
            total += 1
    assert found / total >= 0.99


def test_matched_is_the_edit_distance():
    def brute(a, b):
        best = math.inf
        for i in range(len(b) + 1):
            row = list(range(len(a) + 1))
            best = min(best, row[-1])
            for j in range(i, len(b)):
                new = [row[0] + 1]
                for k in range(len(a)):
                    new.append(min(new[k] + 1, row[k + 1] + 1, row[k] + (a[k] != b[j])))
                row = new
                best = min(best, row[-1])
        return best

    rng = random.Random(6)
    for _ in range(60):
        a, b = ([rng.randint(1, 3) for _ in range(rng.randint(1, 7))] for _ in range(2))
        d, begin, end = decontam.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert d == brute(a, b) and 0 <= begin <= end <= len(b)


def test_fingerprints(spark, corpus):
    out = {r["doc_id"]: r for r in merkle.op6_merkle_fingerprints(spark, SF).collect()}
    order = sorted(corpus)
    for i, d in enumerate(order):
        text, after = corpus[d], corpus[order[(i + 1) % len(order)]]
        cut = len(text) // 4
        edited, r = text[: len(text) - cut] + after[:cut], out[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == str(merkle.build(text)) == str(merkle.parse(r["fingerprint"])) and r["edited_fingerprint"] == str(merkle.build(edited))
        assert 0 <= r["near_next"] <= 1 and r["near_edited"] == pytest.approx(merkle.likeness(merkle.build(text), merkle.build(edited)))
        if len(text) >= 40 and text != after:
            assert r["near_edited"] > r["near_next"]


def test_changes_are_located():
    lines = [f"Paragraph {i} says this. And it says that too." for i in range(60)]
    edited = list(lines)
    edited[17] = lines[17].replace("that", "nothing")
    changed = merkle.changes(str(merkle.build("\n".join(lines))), str(merkle.build("\n".join(edited))))
    assert changed and {n for n, _, _ in changed} == {17}


def test_packing_is_exact(spark, corpus):
    rows = packing.op7_vector_packing(spark, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by, bins, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for d, text in corpus.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        total += ids.size
        for k, r in enumerate(sorted(by[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["length"]) == (k, 4096 * k, min(4096, ids.size - 4096 * k))
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) + 1


def test_rules_of_best_fit():
    lengths = np.array([60, 50, 40, 30, 20, 10])
    for rule in ("norm", "dot"):
        bins = packing.best_fit(lengths, 100, 2, 100.0**2, (1.0, 1e-3, 1e-3), rule)
        assert np.bincount(bins).max() <= 2 and np.bincount(bins, lengths).max() <= 100


def test_words_cut_out_of_order_tokenize_alike():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, known = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for text in ("It's DON'T x,, ÉÈ é ǅ Σας İ 日本 3.14\x1f a<|endoftext|>b", "", " \n ", "Straße... naïve, ŉ ĳ K K"):
        assert known.ids(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_one_word_edits():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice([b"x", b"y"]) for _ in range(rng.randint(1, 5))] for _ in range(2))
        expected = abs(len(a) - len(b)) <= 1 and (
            sum(p != q for p, q in zip(a, b)) <= 1 if len(a) == len(b) else any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b))))
        )
        assert linededup.within_one(a, b) == expected


def test_pipeline_stages_against_brute_force(spark):
    """Each stage is held against a plain computation on its own input."""
    docs = common.documents(spark, SF).cache()
    names = dict(corpus_pipeline.STAGES)
    kept = names["quality"](spark, docs, SF).select("doc_id").collect()
    scored = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted(r[0] for r in scored)
    lines = names["line_dedup"](spark, docs, SF)
    whole = {r["doc_id"]: r for r in linededup.line_dedup(docs).collect()}
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert all(t == whole[d]["kept_text"] for d, t in got.items()) and all(not whole[d]["kept_text"].strip() for d in set(whole) - set(got))
    alone = names["near_duplicates"](spark, docs, SF).select("doc_id").collect()
    assert sorted(r[0] for r in alone) == sorted(r["doc_id"] for r in neardup.near_duplicates(docs).where("kept").collect())
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in names["decontamination"](spark, docs, SF).collect()}
    for r in docs.collect():
        if any(f" {i} " in f" {' '.join(r['text'].lower().split())} " for i in items):
            assert r["doc_id"] not in clean
    assert len(clean) > 0.9 * docs.count()


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
