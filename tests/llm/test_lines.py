"""Lines of any length against a plain computation of the rule."""

from sparkoire.llm import common, linededup

from .conftest import SF


def expected_lines(texts):
    """(id, number of the line) of the lines that go, by comparing every line with every earlier one that shares all but a word."""
    gone, seen, variants = set(), set(), {}
    for key, text in sorted(texts.items()):
        for number, line in enumerate(text.split("\n")):
            words = tuple(line.encode().split())
            if not words:
                continue
            if words in seen:
                gone.add((key, number))
                continue
            seen.add(words)
            if len(words) < 5:
                continue
            around = {words} | {words[:i] + words[i + 1 :] for i in range(len(words))}
            earlier = {w for v in around for w in variants.get(v, ())}
            if any(linededup.within_one(list(words), list(w)) for w in earlier):
                gone.add((key, number))
            for v in around:
                variants.setdefault(v, set()).add(words)
    return gone


def check(spark, df, texts):
    gone = expected_lines(texts)
    for r in linededup.line_dedup(df).collect():
        lines = texts[r["doc_id"]].split("\n")
        assert r["kept_text"] == "\n".join(x for i, x in enumerate(lines) if (r["doc_id"], i) not in gone)
        assert r["n_dropped"] == sum((r["doc_id"], i) in gone for i in range(len(lines)))
    return gone


def test_short_lines(spark):
    texts = {
        1: "Menu\n\nHome page\nread more about this\none two three four five\nMenu", 2: "Menu\n \nHome  page\nread more about that\none two three four six",
        3: "one two three four five six\nHome\nread more about this\na b c d e f g", 4: "a b x d e f g\na b c d\na b c d e f",
    }
    gone = check(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)
    assert gone == {(1, 5), (2, 0), (2, 2), (2, 4), (3, 0), (3, 2), (4, 0), (4, 2)}


def test_lines_of_documents(spark, corpus):
    assert check(spark, common.documents(spark, SF), corpus)
