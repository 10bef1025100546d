"""Tables that are written once, in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a local folder is used; on a cluster that is an error, as
    each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"tallyweave-{os.getpid()}")
    return folder.rstrip("/")


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from there.

    Later readers depend on the files alone, so a lost executor never repeats the work above them.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
