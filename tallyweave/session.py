"""Sessions with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "tallyweave", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on one machine. On a cluster, the session is the caller's; the operators set nothing in it."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
