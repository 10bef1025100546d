"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers; the covariance of the distinct ones is never formed. Passes over the table give the centred product
``X'(XQ) / n`` for a narrow block ``Q``; a Chebyshev recurrence of such passes damps the spectrum that is not wanted, then QR and
Rayleigh-Ritz turn the block, until the residuals of the wanted pairs certify them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.moments import matrix, summed
from tallyweave.llm.shared import free_name, written

#: Entries are counted in units of 1/256.
UNITS = 256
#: Components wanted, and vectors that the block carries beside them.
WANTED, GUARD = 4, 16
#: A filter's degree grows until the best direction is raised by this factor over the damped ones.
RAISE = 1e6
#: Residuals relative to the largest eigenvalue: aimed at, and the worst that is accepted where rounding allows no better.
AIM, WORST = 1e-14, 1e-10
MOST_CYCLES = 300
#: Eigenvalues below this share of the largest count as zero: no component belongs to them.
ZERO = 1e-12


@dataclass(frozen=True)
class Whitening:
    """``components`` is dims x k with unit columns, ``values`` the k eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int


def integers(df: DataFrame, vector: str, out: str) -> DataFrame:
    """The rows whose vector is whole, with ``floor(256 * entry)`` as the array<bigint> column ``out``.

    Rows go whose vector is null or holds a null, a NaN or an infinity, and rows whose vector has no entry, or not the length
    that most rows have (ties: the longer).
    """
    v = F.col(f"`{vector}`")
    x = F.transform(v, lambda c: F.floor(UNITS * c.cast("double")).cast("long"))
    # the largest double below 2**63 / 256: entries beyond it have no long
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 2.0**54), F.lit(False)))
    rows = df.where(good)
    size = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.where(F.size(v) == (size[0]["size"] if size else -1)).withColumn(out, x)


def _product(fit: DataFrame, mean: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """``V q`` in one pass: rows are centred, then multiplied."""
    d, k = q.shape

    def of(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), d) - mean
        return (x.T @ (x @ q)).ravel()

    return summed(fit, of, d * k).reshape(d, k) / n


def _lower_end(product, d: int, rng: np.random.Generator, steps: int = 6) -> float:
    """A number at most a little above the smallest eigenvalue, from a few Lanczos steps, less their residual."""
    basis = [rng.standard_normal(d)]
    basis[0] /= np.linalg.norm(basis[0])
    alpha, beta = [], []
    for _ in range(min(steps, d)):
        w = product(basis[-1][:, None])[:, 0]
        alpha.append(float(basis[-1] @ w))
        for b in basis * 2:  # twice: orthogonal in spite of rounding
            w = w - (b @ w) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(1.0, abs(alpha[0])):
            beta[-1] = 0.0
            break
        basis.append(w / beta[-1])
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, float(values[0] - beta[-1] * abs(vectors[-1, 0])))


def leading(product, d: int, wanted: int = WANTED, guard: int = GUARD, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading eigenpairs of a symmetric, positive semidefinite d x d operator given by ``product(block)``.

    Returns unit columns, falling values and the largest residual relative to the largest value. The filter damps the interval from
    the lower end of the spectrum to the smallest Ritz value of the block. A block as wide as the space needs one pass.
    """
    rng = np.random.default_rng(seed)
    p = min(d, wanted + guard)
    wanted = min(wanted, d)
    q = np.linalg.qr(rng.standard_normal((d, p)))[0]
    low = _lower_end(product, d, rng) if p < d else 0.0
    worst = last = np.inf
    idle = 0
    for _ in range(MOST_CYCLES):
        z = product(q)
        h = q.T @ z
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        q, z = q @ u, z @ u
        top = max(float(values[0]), 0.0)
        if top == 0.0:
            return q[:, :0], values[:0], 0.0
        worst = float(np.max(np.linalg.norm(z - q * values, axis=0)[:wanted])) / top
        idle = idle + 1 if worst > last / 2 else 0
        last = min(last, worst)
        if p == d or worst <= AIM or (worst <= WORST and idle >= 2):
            break
        high = float(values[-1])
        low = min(low, high / 2)
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-15 * top)
        reach = np.arccosh(max((top - centre) / half, 1 + 1e-12))
        degree = int(np.clip(np.log(2 * RAISE) / reach, 2, 24))
        scale = half / (top - centre)  # the recurrence scaled by its growth at the top, so that nothing overflows
        sigma, before, now = scale, q, (z - centre * q) * (scale / half)
        for _ in range(degree - 1):
            after_scale = 1 / (2 / scale - sigma)
            before, now = now, 2 * after_scale / half * (product(now) - centre * now) - sigma * after_scale * before
            sigma = after_scale
        q = np.linalg.qr(now)[0]
    if p < d and worst > WORST:
        raise ArithmeticError(f"components not certified: residual {worst:.2g}")
    keep = int(np.sum(values[:wanted] > ZERO * top))
    return q[:, :keep], values[:keep], worst


def fitted(rows: DataFrame, x: str, wanted: int = WANTED) -> Whitening:
    """Components of the distinct vectors in column ``x`` (``integers``).

    The distinct vectors are written once and read in every pass. Sums and the trace are exact; the driver holds arrays of
    dims x block only. Without rows, or if all are equal, there is no component.
    """
    fit = written(rows.select(F.col(f"`{x}`").alias("x")).distinct(), "distinct")
    by_place = {r.pos: (r.n, int(r.s)) for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()}
    if not by_place:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0.0, 0)
    d, n = len(by_place), by_place[0][0]
    sums = tuple(by_place[i][1] for i in range(d))
    total = fit.agg(F.sum(deviation("x", n, sums)).alias("t")).first().t or Decimal(0)
    trace = float(Fraction(int(total), n**3))
    mean = np.array([float(Fraction(s, n)) for s in sums])
    passes = 0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return _product(fit, mean, q, n)

    vectors, values, residual = leading(product, d, wanted)
    k = len(values)
    turn = vectors / np.sqrt(values)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        y = (matrix(batch.column(0), d) - mean) @ turn
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    error = 0.0
    if k:
        got = summed(fit, of, k + k * k) / n
        error = float(np.max(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k))))
    return Whitening(n, sums, vectors, values, trace, error, residual, passes)


def deviation(x: str, n: int, sums: tuple[int, ...]) -> Column:
    """The sum over the dimensions of ``(n * x - sum)``², exact, as decimal(38,0)."""
    wide = "decimal(38,0)"
    total = F.array(*(F.lit(Decimal(s)).cast("decimal(19,0)") for s in sums))
    gaps = F.zip_with(F.col(f"`{x}`"), total, lambda a, s: (a.cast("decimal(19,0)") * F.lit(Decimal(n)).cast("decimal(18,0)") - s).cast("decimal(19,0)"))
    return F.aggregate(gaps, F.lit(Decimal(0)).cast(wide), lambda acc, g: (acc + (g * g).cast(wide)).cast(wide))


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = WANTED) -> DataFrame:
    """For each row with a whole vector and each component: the key, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``, ``residual`` and ``passes``.

    Rows that ``integers`` leaves out have no row here; a null key is kept; repeated rows count once for the fit and
    are returned each. Fewer than ``wanted`` components come where the distinct vectors span fewer dimensions, none where they
    are all equal or the table is empty. ``deviation`` is null where it exceeds a long. Other columns of ``df`` are not read.
    """
    x = free_name(df.select(F.col(f"`{key}`"), F.col(f"`{vector}`")), "x")
    rows = integers(df.select(F.col(f"`{key}`"), F.col(f"`{vector}`")), vector, x)
    rows = written(rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{x}`").alias("x")), "integers")
    w = fitted(rows, "x", wanted)
    d, k = len(w.sums), len(w.values)
    mean, turn = np.array([float(Fraction(s, w.n)) for s in w.sums]), w.components / np.sqrt(w.values) if k else np.zeros((d, 0))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and k:
                y = (matrix(b.column("x"), d) - mean) @ turn
                lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, k, dtype=np.int32), y.ravel())
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("dev"), lists], names=["k", "dev", "y"])

    kind = rows.schema["k"].dataType.simpleString()
    dev = deviation("x", w.n, w.sums).try_cast("long") if d else F.lit(None).cast("long")
    got = rows.select("k", "x", dev.alias("dev")).mapInArrow(projected, f"k {kind}, dev long, y array<double>")
    explained = F.element_at(F.array(*(F.lit(float(v / w.trace)) for v in w.values)), F.col("component")) if k else F.lit(None).cast("double")
    got = got.select("k", "dev", F.posexplode("y").alias("place", "whitened")).withColumn("component", (F.col("place") + 1).cast("int"))
    return got.select(F.col("k").alias(key), "component", F.lit(w.n).cast("long").alias("n"), F.col("dev").alias("deviation"), "whitened", explained.alias("explained"), F.lit(w.identity_error).alias("identity_error"), F.lit(w.residual).alias("residual"), F.lit(w.passes).alias("passes"))
