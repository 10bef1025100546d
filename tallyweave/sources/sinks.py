"""Sinks: match evidence by run, decisions, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_hashes(local: DataFrame, columns: list[str], out: str = "evidence_hash") -> DataFrame:
    """``local`` with a digest of its identity fields; empty edition qualifiers are left out, so old digests stay valid."""
    used = [F.when(F.size(c) > 0, F.col(c)).alias(c) if c == "edition_qualifiers" else F.col(c) for c in columns]
    return local.withColumn(out, F.sha2(F.to_json(F.struct(*used)), 256))


def write_scores(scores: DataFrame, path: str, run_id: str) -> None:
    """One row per source and candidate of a run, in the run's own partition; a rerun of the same id replaces it."""
    rows = scores.select(F.lit(run_id).alias("run_id"), "source_id", "candidate_key", "rank", "score", "runner_up_margin", "eligible", "hard_contradiction", F.to_json("comparisons").alias("comparisons"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def _path(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, digest) of each file of an export; the digest is a sum over the lines, so it doesn't depend on their order."""
    line = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    read = spark.read.text(f"{path}/data").select("value", F.col("_metadata.file_name").alias("file"))
    return read.groupBy("file").agg(F.count("*").alias("lines"), F.sum(line).cast("string").alias("digest"))


def _seal(manifest: DataFrame) -> DataFrame:
    """One row with the digest of a manifest."""
    row = F.conv(F.substring(F.sha2(F.concat_ws(" ", "file", "lines", "digest"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return manifest.agg(F.concat_ws(":", F.count("*"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)"))).alias("seal"))


def export_plans(plans: DataFrame, path: str) -> None:
    """The stored texts of plans, one per line, with a manifest of the files' digests and a seal of the manifest.

    The seal of an older export goes first and the new one is written last: an export that broke off has none. Files without lines
    are in no manifest. A text with line breaks would become several lines; canonical texts have none.
    """
    spark = plans.sparkSession
    old, files = _path(spark, f"{path}/seal")
    files.delete(old, True)
    plans.select("canonical_json").write.mode("overwrite").text(f"{path}/data")
    _digests(spark, path).write.mode("overwrite").parquet(f"{path}/manifest")
    _seal(spark.read.parquet(f"{path}/manifest")).coalesce(1).write.mode("overwrite").text(f"{path}/seal")


def export_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem) of an export: no seal, another manifest than was sealed, files that lack, were added or changed; none if it is whole."""
    seal, files = _path(spark, f"{path}/seal")
    if not files.exists(seal):
        return spark.createDataFrame([(None, "no seal")], "file string, problem string")
    manifest = spark.read.parquet(f"{path}/manifest")
    sealed = spark.read.text(f"{path}/seal").select(F.col("value").alias("was"))
    broken = _seal(manifest).join(sealed, F.col("seal") == F.col("was"), "left_anti").select(F.lit(None).cast("string").alias("file"), F.lit("manifest does not match its seal").alias("problem"))
    now = _digests(spark, path).select("file", F.col("lines").alias("lines_now"), F.col("digest").alias("digest_now"))
    met = manifest.join(now, "file", "full")
    problem = F.when(F.col("lines_now").isNull(), "file is missing").when(F.col("lines").isNull(), "file was added").when((F.col("lines") != F.col("lines_now")) | (F.col("digest") != F.col("digest_now")), "file was changed")
    return broken.unionByName(met.select("file", problem.alias("problem")).where("problem is not null"))


def import_plans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(drafts, refused): plans of an export that are valid, with digest and length, and the others with reasons.

    Of an export that is not whole (``export_problems``) every plan is refused.
    """
    from tallyweave.operators.plan import validate_plans

    read = spark.read.text(f"{path}/data").where("value <> ''").select(F.col("value").alias("canonical_json"))
    rows = read.withColumn("sha256", F.sha2("canonical_json", 256)).withColumn("byte_length", F.octet_length("canonical_json")).withColumn("status", F.lit("draft"))
    torn = export_problems(spark, path).agg((F.count("*") > 0).alias("_torn"))  # one row
    checked = validate_plans(rows).join(F.broadcast(torn))
    checked = checked.withColumn("reasons", F.when(F.col("_torn"), F.array_append("reasons", F.lit("torn export"))).otherwise(F.col("reasons"))).drop("_torn")
    return checked.where(F.size("reasons") == 0), checked.where(F.size("reasons") > 0)
