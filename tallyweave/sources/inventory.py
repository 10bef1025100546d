"""File inventory from binary files: listing, signatures, fingerprints, failures, state."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = r"(?i)\.(?:epub|pdf|cbz|cbr|rar|r\d{2,3})$"


def inventory(spark: SparkSession, root: str, excluded: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path, size, mtime_ns, content) of media files under ``root``, without those under ``excluded`` (root), from any store that Spark reads.

    Content is a column that is only read if it is used, and null for files over ``max_bytes``, since one row holds a whole file. The store's own
    listing follows links. Where tasks can open the files themselves, ``scanned`` has neither limit.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(F.col("path").rlike(EXTENSIONS))
    row = lambda df, content: df.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), content.alias("content"))
    rows = row(files if max_bytes is None else files.where(F.col("length") <= max_bytes), F.col("content"))
    if max_bytes is not None:
        rows = rows.unionByName(row(files.where(F.col("length") > max_bytes), F.lit(None).cast("binary")))
    return rows if excluded is None else without_roots(rows, excluded)


def scanned(spark: SparkSession, root: str, excluded: list[str] | None = None, folders: int = 256) -> DataFrame:
    """(path, size, mtime_ns, sha256, signature, format, error) of media files under a mounted folder (``media_files.MediaFiles``).

    Links are skipped, files of any size are hashed in chunks by the tasks, and a file or folder that cannot be read is a row with ``error``, an
    empty hash and the signature ``unreadable``. ``excluded`` folders are not entered. The driver lists about ``folders`` folders, the tasks the rest.
    """
    from tallyweave.sources.media_files import MediaFiles

    spark.dataSource.register(MediaFiles)
    rows = spark.read.format(MediaFiles.name()).option("folders", folders).option("excluded", json.dumps(excluded or [])).load(root)
    known = with_signature(rows.withColumnRenamed("head", "content")).drop("content")
    broken = F.col("error").isNotNull()
    return known.select("path", "size", "mtime_ns", F.coalesce("sha256", F.lit("")).alias("sha256"), F.when(broken, "unreadable").otherwise(F.col("signature")).alias("signature"), F.when(broken, "unknown").otherwise(F.col("format")).alias("format"), "error")


def without_roots(rows: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is none of the roots and lies under none: each folder above a path meets the roots by equality."""
    from tallyweave.operators.verify import path_prefixes

    keys = rows.select(path).distinct().withColumn("_root", F.explode(path_prefixes(F.col(path))))
    bad = keys.join(roots.select(F.regexp_replace("root", "/+$", "").alias("_root")), "_root", "left_semi").select(path).distinct()
    return rows.join(bad, path, "left_anti")


def signature(content: Column, path: Column) -> Column:
    """What the first bytes say: pdf, rar, zip-epub, zip or unknown, unreadable without any; the suffix only tells book archives from others."""
    head = F.hex(F.substring(content, 1, 8))
    zip_ = F.startswith(head, F.lit("504B0304")) | F.startswith(head, F.lit("504B0506"))
    rar = F.startswith(head, F.lit("526172211A0700")) | F.startswith(head, F.lit("526172211A070100"))
    return F.when(F.startswith(head, F.lit("255044462D")), "pdf").when(rar, "rar").when(zip_ & F.lower(path).endswith(".epub"), "zip-epub").when(zip_, "zip").when(content.isNull(), "unreadable").otherwise("unknown")


def with_signature(rows: DataFrame) -> DataFrame:
    """``rows`` with ``signature`` and ``format``."""
    formats = F.create_map(*(F.lit(x) for kv in (("pdf", "pdf"), ("rar", "cbr"), ("zip-epub", "epub"), ("zip", "cbz")) for x in kv))
    marked = rows.withColumn("signature", signature(F.col("content"), F.col("path")))
    return marked.withColumn("format", F.coalesce(F.try_element_at(formats, F.col("signature")), F.lit("unknown")))


def with_sha256(rows: DataFrame) -> DataFrame:
    """``rows`` with the SHA-256 of their content, which is dropped."""
    return rows.withColumn("sha256", F.sha2("content", 256)).drop("content")


def with_failures(listing: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Every listed path; those without a fingerprint have an empty hash and the signature ``unreadable``."""
    rest = [c for c in fingerprints.columns if c not in listing.columns]
    met = listing.join(fingerprints.select("path", *rest), "path", "left")
    defaults = {"sha256": "", "signature": "unreadable", "format": "unknown"}
    return met.select(*(F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in met.columns))


def upsert_sources(state: DataFrame, scan: DataFrame, key: str = "path", seen: str = "seen_at") -> DataFrame:
    """The newest attributes of each path, with first_seen and last_seen. ``state`` has both, ``scan`` has ``seen_at``."""
    rest = [c for c in scan.columns if c not in (key, seen)]
    old = state.select(key, *rest, F.col("first_seen"), F.col("last_seen"))
    new = scan.select(key, *rest, F.col(seen).alias("first_seen"), F.col(seen).alias("last_seen"))
    got = old.unionByName(new).groupBy(key).agg(F.max_by(F.struct(*rest), "last_seen").alias("r"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return got.select(key, *(F.col(f"r.{c}").alias(c) for c in rest), "first_seen", "last_seen")
