"""Helpers that the training-data operators share: table access and written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tallyweave.written import shared_folder, written

#: White space that separates words, as the inside of a character class: space and 0x09 to 0x0D.
SPACE = r"\x20\x09-\x0D"
#: The same characters as a string, for trim functions.
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Put:
    """Writes tables into one folder of its own inside the shared folder: ``put(df, name)`` is ``written`` there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.kept = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", False

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.folder)

    def stay(self) -> None:
        """The tables are part of a result: they stay until the owner of the shared folder clears it."""
        self.kept = True

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Put]:
    """Intermediate tables that are deleted behind the block, once what depends on them was written elsewhere."""
    put = Put(spark)
    try:
        yield put
    finally:
        if not put.kept:
            put.drop()


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
