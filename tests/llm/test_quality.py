"""Features against brute force, learning on planted rules, and edge cases."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tallyweave.llm import quality as Q

TEXTS = [None, "", "  \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x\nx\n\nx\ny", "#a*b $ % & | < >", "w " * 3000, " ".join(map(str, range(4000))), "a b c d e f g h i a b c d e f g h j", "ä ö ü\x1f"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_features(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = Q.word_features(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()
    for r in rows:
        assert tuple(r[c] for c in Q.COUNTS) == brute(texts[r.k]), texts[r.k]


def test_learns_planted_rule_and_keeps_clean(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, " ".join(word() + ("##" if bad and rng.random() < 0.5 else "") for _ in range(60)), "x"))
        if i < 200:
            labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, rule string")
    marks = spark.createDataFrame(labels + [(None, 0), (9999, 0), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in Q.judged(docs, marks).collect()}
    assert all(got[i] == (i % 5 != 0) for i in range(400))
    kept = Q.kept_rows(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 5}


def test_first_rule_that_holds_decides(spark):
    rules = [Q.RejectRule((Q.Condition("words", True, 3.0), Q.Condition("words", False, 9.0)), 1.0, 5), Q.RejectRule((Q.Condition("words", True, 0.0),), 1.0, 5)]
    got = spark.createDataFrame([(0.0,), (2.0,), (5.0,), (20.0,)], "w double").select(Q.verdict(rules, {"words": F.col("w")}).alias("v")).collect()
    assert [r.v for r in got] == [0, 2, 1, 2]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (None, None), (1, "a b c d e f g h i j k l m n o p q r s t u")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in Q.judged(docs, none).collect())
    assert got == [(0, 0, True, False), (1, 21, False, True), (1, 30, True, False)]
    assert Q.judged(docs.limit(0), none).count() == 0 and Q.kept_rows(docs.limit(0), none).count() == 0


def test_clashing_names_pass(spark):
    text = "a b c d e f g h " * 3
    df = spark.createDataFrame([("x", text, 1, 2, 3, 4)], "n_words string, text string, _w int, _l int, N_WORDS_ int, _row int")
    r = Q.word_features(df).first()
    assert (r.n_words, r._w, r._l, r.N_WORDS_, r._row, r.n_words__, r.n_repeat_words) == (24, 1, 2, 3, 4, "x", 24)
    assert Q.word_features(df.select("text")).columns == ["n_symbols", "n_words", "word_chars", "n_dup_lines", "n_repeat_words"]
