"""Spans against Python's own matching, and the trigram queries."""

import random
import re

from pyspark.sql import functions as F

from tallyweave.llm import secrets as S


def brute(text, rules=S.RULES):
    found = []
    for place, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.I | re.A if r.any_case else 0):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), place, m.end(), r.kind))
    return [(a, b, k) for a, _, b, k in sorted(found)]


PIECES = ["password", "PASSWD", "Secret", "tokentoken", "api_key", "APIKEY", '"', "'", " ", ":", "=", " = ", "abcdef", "a", "x" * 9, "AKIA", "A" * 16, "0123456789abcdef", "f" * 24, "é", "😀", "\n", "ghp_" + "a1" * 18, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "b" * 35, "eyJabc.eyJdef.ghi" + "x" * 40, "sk_live_" + "k" * 20]


def test_spans_match_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "token=abcdef" * 300] + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(0, None), (None, "token=abcdef"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("kinds", F.lit(2))
    got = S.scanned(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r.doc_id] if r.doc_id is not None else "token=abcdef")
        assert [tuple(x) for x in r.found] == want


def test_queries_hold_for_every_match():
    rng = random.Random(2)
    for r in S.RULES:
        query = S.trigram_query(r)
        for _ in range(300):
            text = "".join(rng.choice(PIECES) for _ in range(8))
            if re.search(r.pattern, text, re.I | re.A if r.any_case else 0):
                folded = text.lower() if r.any_case else text
                assert any(all(t in folded for t in a) for a in query), (r.kind, text)
    assert S.trigram_query(S.BASE[2]) == S.ALL  # no mandatory trigram: scans every text
    assert S.trigram_query(S.SecretRule("x", "xyz[0-9]+(?:abc|de)")) == frozenset({frozenset({"xyz"})})
    assert S.trigram_query(S.SecretRule("x", "ab[cd]e*")) == frozenset({frozenset({"abc"}), frozenset({"abd"})})
    assert S.trigram_query(S.SecretRule("x", "ab(?:cd|ef)+")) == S.ALL  # nothing of three characters is certain


def test_only_unindexed_rules_and_empty_table(spark):
    df = spark.createDataFrame([(1, "f" * 30)], "doc_id long, text string")
    assert [tuple(x) for x in S.scanned(df, rules=(S.BASE[2],)).first().found] == [(0, 30, "hex")]
    assert S.scanned(df.limit(0)).count() == 0
