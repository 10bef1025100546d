"""A quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each class has a mean and a covariance, shrunk towards the pooled one and its diagonal; a text's score comes from the difference of the two
log densities by Mahalanobis distances, whose Cholesky factors are made once and go to the tasks with the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.moments import matrix, summed
from tallyweave.llm.shared import free_name, written

STATISTICS = ("words", "word_length", "symbols", "exclamations", "digits", "stops", "other_marks", "upper_case", "repeated_words", "repeated_triples", "repeated_lines", "line_length", "beyond_ascii")
#: Share of the pooled covariance in a class's, then of the pooled diagonal in both.
TO_POOLED, TO_DIAGONAL = 0.5, 0.1
#: About this many labelled keys are learned from at most, chosen by digest; with fewer, all are.
MOST_LABELS = 200_000
#: A text is predicted good from this score on.
THRESHOLD = 0.3
#: Log-density differences beyond this count as this; cells of the calibration have this width.
FAR, CELL = 60.0, 0.25

def _bytes(wanted: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(wanted, np.uint8)).astype(float)


_UPPER, _LOWER, _HIGH = _bytes(bytes(range(65, 91))), _bytes(bytes(range(97, 123))), _bytes(bytes(range(128, 256)))
_SYMBOL, _LOUD, _DIGIT, _STOP = _bytes(b"#*$%&|<>"), _bytes(b"!?"), _bytes(b"0123456789"), _bytes(b".,;:")
_OTHER = _bytes(bytes(range(33, 127))) - _UPPER - _LOWER - _SYMBOL - _LOUD - _DIGIT - _STOP
_CLASSES = np.stack([_UPPER, _LOWER, _HIGH, _SYMBOL, _LOUD, _DIGIT, _STOP, _OTHER])


def _odds(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (max(whole - part, 0.0) + 1))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text in UTF-8: logarithms of counts, of rates by byte, and log odds of shares."""
    upper, lower, high, symbols, loud, digits, stops, other = (_CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist()
    words = text.split()  # bytes split at the six ASCII white spaces
    n, size = len(words), len(text) + 1
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    triples = max(n - 2, 0)
    if triples:
        pairs = np.unique(codes[:-1] * len(ids) + codes[1:], return_inverse=True)[1]
        distinct = len(np.unique(pairs[:-1] * np.int64(len(ids)) + codes[2:]))
    else:
        distinct = 0
    lines = [s for x in text.split(b"\n") if (s := x.strip())]
    letters = upper + lower + high
    rate = lambda c: math.log(1000 * (c + 0.5) / size + 0.1)
    return [math.log(n + 1), math.log((letters + 1) / (n + 1)), rate(symbols), rate(loud), rate(digits), rate(stops), rate(other), _odds(upper, letters), _odds(n - len(ids), n), _odds(triples - distinct, triples), _odds(len(lines) - len(set(lines)), len(lines)), math.log((n + 1) / (len(lines) + 1)), rate(high)]


def statistics_of(text: Column) -> Column:
    """The statistics of a text column as array<double>; a null text counts as empty."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return of(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Model:
    """Of the bad and the good class: mean, inverse Cholesky factor of the covariance, and log prior less the log root of its determinant.

    ``slope`` and ``offset`` turn a log-density difference into log odds. Without both classes only ``offset`` counts.
    """

    means: np.ndarray
    factors: np.ndarray
    heights: np.ndarray
    slope: float
    offset: float

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Log density of the good class less that of the bad one, for each row."""
        if not len(self.means):
            return np.zeros(len(x))
        bad, good = (h - 0.5 * np.sum(((x - m) @ f.T) ** 2, axis=1) for m, f, h in zip(self.means, self.factors, self.heights, strict=True))
        return np.clip(good - bad, -FAR, FAR)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(x) + self.offset, -700, 700)))


def calibration(cells: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (difference, bad, good) counts, the slope not below zero.

    Newton steps on smoothed targets, so that classes which never meet get a finite curve.
    """
    x, bad, good = (np.array(v, float) for v in zip(*cells, strict=True))
    high, low = (good.sum() + 1) / (good.sum() + 2), 1 / (bad.sum() + 2)
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * x + b
        both = np.logaddexp(0, z)
        return float(np.sum(good * (both - high * z) + bad * (both - low * z)))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -700, 700)))
        n = bad + good
        slack = n * p - good * high - bad * low
        g = np.array([slack @ x, slack.sum()])
        h = np.array([[(n * p * (1 - p)) @ (x * x), (n * p * (1 - p)) @ x], [(n * p * (1 - p)) @ x, (n * p * (1 - p)).sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        t, now = 1.0, loss(a, b)
        while t > 1e-6 and loss(a - t * step[0], b - t * step[1]) > now:
            t /= 2
        a, b = a - t * step[0], b - t * step[1]
        if t * np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (0.0, math.log((good.sum() + 1) / (bad.sum() + 1)))


def _sums(rows: DataFrame, centres: np.ndarray | None, d: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class the weight and either the sum of the statistics or, given ``centres``, the sum of their centred products."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), d)
        out = []
        for c in (0, 1):
            w = batch.column(1 + c).to_numpy().astype(float)
            if centres is None:
                out.append(np.concatenate([[w.sum()], w @ x]))
            else:
                e = x - centres[c]
                out.append(np.concatenate([[w.sum()], (e.T @ (e * w[:, None])).ravel()]))
        return np.concatenate(out)

    got = summed(rows, of, 2 * (1 + (d if centres is None else d * d))).reshape(2, -1)
    return got[:, 0], got[:, 1:]


def learn(rows: DataFrame, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """The model from ``rows``: z (statistics), bad and good (how often the row is labelled so).

    Three passes: means, centred covariances, and counts of log-density differences in cells for the calibration. The driver holds
    sums by class and at most 481 cells. With no row of a class the score is the smoothed share of good labels.
    """
    d = len(STATISTICS)
    weight, sums = _sums(rows, None, d)
    if min(weight) == 0:
        return Model(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), 0.0, math.log((weight[1] + 1) / (weight[0] + 1)))
    means = sums / weight[:, None]
    _, products = _sums(rows, means, d)
    products = products.reshape(2, d, d)
    pooled = products.sum(axis=0) / weight.sum()
    diagonal = np.diag(np.diag(pooled) + 1e-6)
    factors, heights = [], []
    for c in (0, 1):
        s = (1 - to_pooled) * products[c] / weight[c] + to_pooled * pooled
        lower = np.linalg.cholesky((1 - to_diagonal) * s + to_diagonal * diagonal)
        factors.append(np.linalg.inv(lower))
        heights.append(math.log(weight[c] / weight.sum()) - float(np.sum(np.log(np.diag(lower)))))
    raw = Model(means, np.array(factors), np.array(heights), 1.0, 0.0)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = np.round(raw.differences(matrix(b.column(0), d)) / CELL).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(1), b.column(2)], names=["cell", "bad", "good"])

    counted = rows.mapInArrow(cells, "cell long, bad long, good long").groupBy("cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).orderBy("cell").collect()
    slope, offset = calibration([(r.cell * CELL, r.bad, r.good) for r in counted])
    return Model(raw.means, raw.factors, raw.heights, slope, offset)


def held_out(key: Column) -> Column:
    """Whether a key's labels are never learned from: its decimal text's CRC-32 is divisible by five. False for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def marks(labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = MOST_LABELS) -> DataFrame:
    """One row per labelled key that may be learned from: key, bad and good (numbers of labels 0 and 1).

    Null keys and labels other than 0 and 1 are left out. Of more than ``most`` keys, those whose digest lies below the share
    that keeps about ``most`` stay: the table's size is bounded, so it may be broadcast.
    """
    k, y = F.col(f"`{key}`"), F.col(f"`{label}`")
    good = labels.where(k.isNotNull() & y.isin(0, 1) & ~held_out(k)).select(k.alias("key"), y.alias("y"))
    rows = good.groupBy("key").agg(F.sum((F.col("y") == 0).cast("long")).alias("bad"), F.sum((F.col("y") == 1).cast("long")).alias("good"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("key", F.lit("learn")), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return rows


def scored(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, most: int = MOST_LABELS, **shrinkage) -> DataFrame:
    """One row per row of ``df``: the key, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` and ``difference`` (of the log densities).

    The statistics of whole texts are made once, written, and read for learning and for scoring; only they enter a score. Labels meet
    them by a broadcast of ``marks``, so the statistics are not shuffled; a row with several labels counts with each, rows with equal
    keys each. A null or empty text has the statistics of an empty one and is scored; a null key is scored and never learned from.
    Without labels of both classes every score is the smoothed share of good labels (0.5 without any). An empty table gives no rows. Other columns
    of either table are not read.
    """
    features = written(df.select(F.col(f"`{key}`").alias("key"), statistics_of(F.col(f"`{text}`")).alias("z")), "statistics")
    known = features.join(F.broadcast(marks(labels, key, label, most)), "key").select("z", "bad", "good")
    model = learn(written(known, "labelled"), **shrinkage)
    d = len(STATISTICS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("z"), d)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(model.scores(x)), pa.array(model.differences(x))], names=["key", "score", "difference"])

    kind = features.schema["key"].dataType.simpleString()
    got = features.mapInArrow(score, f"key {kind}, score double, difference double")
    name = free_name(got.drop("key"), key)
    assert name == key, f"the key's name {key} is one of the result's"
    return got.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")
