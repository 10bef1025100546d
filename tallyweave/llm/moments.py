"""Sums of arrays over all rows of a table: partial sums in the tasks, united in a second step, so that the driver gets few."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _sums(parts: Iterator[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(width)
    for p in parts:
        total += p
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])


def summed(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum over the batches of ``df`` of the ``width`` numbers that ``of`` makes of each; zeros for an empty table.

    A task returns one array whatever it reads. The arrays meet in about the square root of as many tasks before they go to
    the driver, which holds ``width`` times that root: 300 arrays for 100,000 tasks.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sums((of(b) for b in batches if b.num_rows), width)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sums((matrix(b.column(0), width).sum(axis=0) for b in batches if b.num_rows), width)

    few = max(1, math.isqrt(df.rdd.getNumPartitions()))
    got = df.mapInArrow(first, "v array<double>").repartition(few).mapInArrow(second, "v array<double>").collect()
    return np.sum([r.v for r in got], axis=0) if got else np.zeros(width)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of lists of ``width`` numbers as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
