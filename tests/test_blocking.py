"""Blocking, similarity and ratios against brute force: no pair more than survives, none lost, hot keys in parts."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import ratio
from tallyweave.operators import candidates


def texts(rng, alphabet, most):
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most)))


def test_blocks_match_the_standard_ones():
    rng = random.Random(1)
    for n in range(3000):
        alphabet = rng.choice(("ab", "abc ", "abcdefghijklmnopqrstuvwxyz "))
        a = texts(rng, alphabet, 300 if n % 30 == 0 else 40)
        b = list(a) if rng.random() < 0.5 else list(texts(rng, alphabet, 300 if n % 30 == 0 else 40))
        for _ in range(rng.randrange(5)):
            b[rng.randrange(len(b))] = rng.choice(alphabet)
        b = "".join(b)
        assert ratio.matched(a, b) == sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks()), (a, b)


@pytest.mark.parametrize("on", [None, ["k"]])
def test_ratios_of_rows(spark, on, monkeypatch):
    rng = random.Random(2)
    rows = [(k % 50, *rng.choice([("the private thread", "a privat thrd"), (texts(rng, "abc ", 20), texts(rng, "abc ", 20)), ("x", "x"), ("", "y"), (None, "z"), (None, None)])) for k in range(300)]
    got = ratio.with_ratios(spark.createDataFrame(rows, "k int, a string, b string").withColumn("_notes2", F.lit(1)), {"r": (F.col("a"), F.col("b"))}, on).collect()
    assert len(got) == len(rows) and all(abs(r.r - SequenceMatcher(None, r.a or "", r.b or "").ratio()) < 1e-12 for r in got)


def test_each_distinct_pair_is_compared_once(spark):
    """The exchange compares as many rows as there are distinct unequal pairs."""
    df = spark.range(400).select("id", F.lit("private thread").alias("a"), F.when(F.col("id") % 2 == 0, "privat thrd").otherwise("other").alias("b")).repartition(7)
    rows = ratio.with_ratios(df, {"r": (F.col("a"), F.col("b"))}, ["id"])
    assert rows.select("r").distinct().count() == 2
    rows.collect()
    made = [int(n.metrics().apply("pythonNumRowsReceived").value()) for n in nodes(rows._jdf.queryExecution().executedPlan()) if "ArrowEvalPython" in n.nodeName()]
    assert made == [2]


def nodes(plan):
    """All nodes of an executed plan, stages included."""
    out, work = [], [plan]
    while work:
        p = work.pop()
        out.append(p)
        name = p.nodeName()
        children = [p.children().apply(i) for i in range(p.children().size())]
        if name.startswith("AdaptiveSparkPlan"):
            children.append(p.executedPlan())
        elif "QueryStage" in name:
            children.append(p.plan())
        work += children
    return out


def catalogue(spark, n, hot):
    """Records of which ``hot`` share one title and creator."""
    who = lambda i: "Ann" if i < hot else f"W{i % 7}"
    rows = [(str(i), "Same Title" if i < hot else f"T {i % 11}", [(who(i), "author")]) for i in range(n)]
    found = spark.createDataFrame([("c" + k, "f", t, None, None, c) for k, t, c in rows], "candidate_key string, provider string, title string, subtitle string, series_title string, creators array<struct<name: string, role: string>>")
    ladder = spark.createDataFrame([(k, 0, "structured", t, [c[0][0]] if int(k) % 3 else []) for k, t, c in rows], "source_id string, ordinal int, label string, title string, creators array<string>")
    return rows, ladder, found


@pytest.mark.parametrize("crowded", [candidates.CROWDED, 50])
def test_title_pairs_make_what_survives(spark, crowded):
    rows, ladder, found = catalogue(spark, 120, 40)
    want = {(a, "c" + b) for a, t, c in rows for b, t2, c2 in rows if t == t2 and (int(a) % 3 == 0 or c[0][0] == c2[0][0])}
    got = candidates.title_pairs(ladder, found, crowded)
    pairs = [(r.source_id, r.candidate_key) for r in got.collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    met = candidates.dealt_join(candidates._asked(ladder), candidates._offered(found), ["key", "who"], "source_id", "candidate_key", crowded)
    assert met.count() == len(want)  # the join itself makes no other pair


def test_hot_blocks_are_dealt(spark):
    n = 200
    left = spark.range(n).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("a"))
    right = spark.range(n // 4).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("b"))
    met = candidates.dealt_join(left, right, ["key"], "a", "b", crowded=500)
    assert met.distinct().count() == met.count() == n * n // 4
    assert candidates.dealt_join(left.limit(0), right, ["key"], "a", "b").count() == 0


def grams(key):
    padded = f"  {key}  "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


@pytest.mark.parametrize("at_least", [0.3, 0.5, 0.8, 1.0])
def test_similar_keys_find_all(spark, at_least):
    rng = random.Random(3)
    keys = [texts(rng, "abcd ", 14).strip() for _ in range(150)] + ["the long night", "the long knight", "a", "aa", "", "the long night"]
    more = [k[:i] + rng.choice("abxy") + k[i + 1 :] for k in keys for i in [rng.randrange(len(k) + 1)]] + [None]
    jaccard = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    want = {(a, b): jaccard(a, b) for a in set(keys) - {""} for b in set(more) - {"", None} if jaccard(a, b) >= at_least}
    got = candidates.similar_keys(*(spark.createDataFrame([(k,) for k in x], "key string") for x in (keys, more)), at_least).collect()
    assert len(got) == len(want) and all(abs(want[r.key, r.other] - r.similarity) < 1e-12 for r in got)


def test_similar_tier(spark):
    _, ladder, found = catalogue(spark, 30, 10)
    none = spark.createDataFrame([], "source_id string, provider string")
    typo = ladder.withColumn("title", F.regexp_replace("title", "Same Title", "Same Titel"))
    got = {(r.source_id, r.candidate_key) for r in candidates.similar_pairs(typo.where("source_id < 10"), found, none).collect()}
    assert got and all(int(c[1:]) < 10 for _, c in got)
    taken = spark.createDataFrame([(str(i), "f") for i in range(10)], "source_id string, provider string")
    assert candidates.similar_pairs(typo.where("cast(source_id as int) < 10"), found, taken).count() == 0
