"""Components against a dense eigensolver, exact sums against big integers, and edge cases."""

import math
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import queries
from tallyweave.llm import whitening as W
from tests.conftest import SF


def dense(vectors):
    """For whole vectors: integers, distinct ones, their sums and the eigenpairs of their covariance."""
    x = [tuple(math.floor(256 * float(c)) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    e = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(e.T @ e / n)
    return x, n, sums, values[::-1], vectors[:, ::-1]


def check(rows, vectors, k):
    x, n, sums, values, axes = dense(vectors)
    got = {}
    for r in rows:
        got.setdefault(r.component, []).append(r)
    assert sorted(got) == list(range(1, k + 1)) and len(rows) == k * len(x)
    deviations = Counter(sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x)
    centred = np.array(x, float) - np.array(sums) / n
    for c, part in got.items():
        assert {r.n for r in part} == {n} and Counter(r.deviation for r in part) == deviations
        assert abs(part[0].explained / (values[c - 1] / values.sum()) - 1) < 1e-9 and part[0].identity_error < 1e-9
        by_key = {r.vec_id: r.whitened for r in part}
        want = centred @ axes[:, c - 1] / math.sqrt(values[c - 1])
        mine = np.array([by_key[i] for i in range(len(x))])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    whole = [r for r in table if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    rows = queries.op12_whitening(spark, SF).collect()
    place = {r.vec_id: i for i, r in enumerate(sorted(whole, key=lambda r: r.vec_id))}
    assert len(place) == len(whole)
    check([type(r)(**(r.asDict() | {"vec_id": place[r.vec_id]})) for r in rows], [r.embedding for r in sorted(whole, key=lambda r: r.vec_id)], 4)
    assert rows[0].residual <= W.WORST and rows[0].passes > 4


def test_repeats_and_broken_rows(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((60, 5)) * [1, 3, 0.5, 2, 0.1]).round(3).tolist()
    good = good + good[:20] + [good[0]] * 30
    rows = [(i, v, 1) for i, v in enumerate(good)]
    rows += [(900, None, 1), (901, [1.0, None, 2.0, 3.0, 4.0], 1), (902, [float("nan")] * 5, 1), (903, [float("inf"), 1.0, 1.0, 1.0, 1.0], 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [1e300] * 5, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int").repartition(7)
    check(W.whitened(df).collect(), good, 4)
    with_null_key = W.whitened(df.withColumn("vec_id", F.when(F.col("vec_id") != 3, F.col("vec_id"))))
    assert with_null_key.where("vec_id is null").count() == 4


@pytest.mark.parametrize(("vectors", "k"), [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 4, 0), ([[0.0, 1.0], [1.0, 0.0]], 1), ([[0.0], [1.0], [3.0]], 1)])
def test_few_dimensions(spark, vectors, k):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    rows = W.whitened(df).collect()
    assert len(rows) == k * len(vectors)
    if k:
        check(rows, vectors, k)


def test_leading_pairs_of_wide_operators():
    rng = np.random.default_rng(5)
    for spectrum in (np.geomspace(1, 1e-9, 200), np.linspace(1.07, 0.93, 200), np.r_[5, 5, 5, 5, np.ones(196)], np.r_[3, 2, np.zeros(198)]):
        axes = np.linalg.qr(rng.standard_normal((200, 200)))[0]
        a = (axes * spectrum) @ axes.T
        vectors, values, residual = W.leading(lambda q, a=a: a @ q, 200)
        k = min(4, int((spectrum > 0).sum()))
        assert residual <= W.WORST and len(values) == k and np.abs(values - spectrum[:k]).max() < 1e-10
        assert np.abs(a @ vectors - vectors * values).max() < 1e-9


def test_exact_beyond_doubles(spark):
    n, sums = 10**9, (10**15 + 7, -(10**14))
    row = spark.createDataFrame([([123_457, -3],)], "x array<bigint>").select(W.deviation("x", n, sums).alias("d")).first()
    assert row.d == Decimal((n * 123_457 - sums[0]) ** 2 + (n * -3 - sums[1]) ** 2)
