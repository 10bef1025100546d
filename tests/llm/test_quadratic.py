"""Held-out accuracy, densities against plain formulas, what a score may depend on, and edge cases."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import quadratic as Q
from tallyweave.llm import queries

SF = "/root/testdata/sf0.01"


def texts(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    return [(i, " ".join(word() + ("##" if i % 3 == 0 and rng.random() < 0.4 else "") for _ in range(rng.randrange(20, 90))), i % 3 != 0) for i in range(n)]


def test_held_out_accuracy(spark):
    got = queries.op11_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r for r in got if r.quality == q] for q in (1, 0))
    assert len(bad) >= 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    above = sum((g.score > b.score) + (g.score == b.score) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert above > 0.97 and sum(r.predicted for r in good) / len(good) > 0.97 and sum(r.predicted for r in bad) / len(bad) < 0.2


def test_only_texts_and_learned_labels_count(spark):
    rows = texts(240)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, quality int")
    one = {r.doc_id: r for r in Q.scored(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in one.items())
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    more = docs.withColumn("score", F.lit(1)).withColumn("z", F.lit(2)).withColumn("lang", F.lit("xx")).repartition(5)
    two = {r.doc_id: r for r in Q.scored(more, turned).collect()}
    assert all(abs(one[i].score - two[i].score) < 1e-9 for i in one)
    right = [r.predicted == (i % 3 != 0) for i, r in one.items() if r.held_out]
    assert sum(right) / len(right) > 0.95


def test_densities_and_bounded_labels(spark):
    rng = np.random.default_rng(2)
    d = len(Q.STATISTICS)
    x = np.concatenate([rng.standard_normal((80, d)), rng.standard_normal((120, d)) * 2 + 1])
    y = np.r_[np.zeros(80, int), np.ones(120, int)]
    rows = spark.createDataFrame([(v.tolist(), int(c == 0), int(c == 1)) for v, c in zip(x, y, strict=True)], "z array<double>, bad long, good long").repartition(3)
    m = Q.learn(rows)
    want = []
    pooled = sum(np.cov(x[y == c].T, bias=True) * (y == c).mean() for c in (0, 1))
    for c in (0, 1):
        s = (1 - Q.TO_POOLED) * np.cov(x[y == c].T, bias=True) + Q.TO_POOLED * pooled
        s = (1 - Q.TO_DIAGONAL) * s + Q.TO_DIAGONAL * np.diag(np.diag(pooled) + 1e-6)
        e = x - x[y == c].mean(axis=0)
        want.append(math.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.sum(e * np.linalg.solve(s, e.T).T, axis=1))
    assert np.abs(m.differences(x) - np.clip(want[1] - want[0], -Q.FAR, Q.FAR)).max() < 1e-9
    order = np.argsort(m.differences(x))
    assert m.slope > 0 and (np.diff(m.scores(x)[order]) >= 0).all()
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    some = Q.marks(labels.union(labels), most=1000)
    assert 850 < some.count() < 1150 and some.agg(F.max(F.col("bad") + F.col("good"))).first()[0] == 2
    assert Q.marks(labels).where(Q.held_out(F.col("key"))).count() == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b c"), (2, " \n"), (3, "x " * 50_000), (4, "ä\x1f ## 12 !")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.scored(docs, none).collect()] == [0.5] * 6
    one_class = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, 2), (4, None)], "doc_id long, quality int")
    got = Q.scored(docs, one_class).collect()
    n = sum(not r.held_out for r in got if r.doc_id == 1) * 2
    assert all(abs(r.score - (n + 1) / (n + 2)) < 1e-12 for r in got)
    both = spark.createDataFrame([(k, q) for k in range(40) for q in (0, 1)], "doc_id long, quality int")
    got = Q.scored(docs, both).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and not next(r for r in got if r.doc_id is None).held_out
    empty = [r.score for r in got if r.doc_id in (1, 2)]
    assert empty[0] == empty[1]
    assert Q.scored(docs.limit(0), both).count() == 0
