"""Inputs that the registered queries derive from the driver's tables, each by one rule that SQL can state as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.sequence import sequence_struct
from tallyweave.schemas import CREDITS, IDENTIFIERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks by their key: a table that is small in bytes is few splits, however much is done with each of its rows.

    In as many partitions as the session shuffles into, which are not merged by size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


TYPES = {"signup": "accepted", "purchase": "work_accepted", "click": "manual_override", "view": "skipped", "error": "rejected"}


def part_locals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as local books: name is the title, brand the creator, size the year."""
    p = table(spark, sf_dir, "part")
    none = lambda kind: F.lit(None).cast(kind)
    return p.select(
        F.col("p_partkey").cast("string").alias("source_id"), F.lit("book").alias("kind"), F.lit("standalone-book").alias("subtype"), F.lit(0.98).alias("classification_confidence"), F.col("p_name").alias("title"), F.array("p_brand").alias("creators"), F.array().cast(IDENTIFIERS).alias("identifiers"), none("string").alias("series_title"),
        sequence_struct(none("string")).alias("sequence"), (F.col("p_size") + 2000).cast("int").alias("year"), none("int").alias("run_start_year"), none("string").alias("publisher"), none("string").alias("language"), F.array().cast("array<string>").alias("edition_qualifiers"),
    )


def part_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogue works."""
    p = table(spark, sf_dir, "part")
    none = lambda kind: F.lit(None).cast(kind)
    return p.select(
        F.format_string("work:%d:book_work", "p_partkey").alias("candidate_key"), F.lit("work").alias("provider"), F.col("p_partkey").cast("string").alias("provider_id"), F.lit("book_work").alias("record_type"), F.lit("book").alias("media_kind"), F.col("p_name").alias("title"), none("string").alias("subtitle"),
        F.array(F.struct(F.col("p_brand").alias("name"), F.lit("author").alias("role"))).cast(CREDITS).alias("creators"), F.array().cast(IDENTIFIERS).alias("identifiers"), none("string").alias("publisher"), (F.col("p_size") + 2000).cast("string").alias("publication_date"),
        *(none("string").alias(c) for c in ("release_date", "release_date_precision", "cover_date", "cover_date_precision", "language", "series_title")), none("int").alias("run_start_year"), sequence_struct(none("string")).alias("sequence"), *(none("string").alias(c) for c in ("item_type", "work_id", "edition_id", "run_id")), F.create_map().cast("map<string,string>").alias("provider_metadata"), F.lit(1).alias("provider_schema_version"),
    )


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as messy comic file names, four shapes in turn."""
    p = table(spark, sf_dir, "part")
    name, n = F.initcap("p_name"), F.col("p_size")
    year = (F.col("p_partkey") % 60 + 1960).cast("int")
    stem = (
        F.when(F.col("p_partkey") % 4 == 0, F.format_string("%s #%03d (%d) (Digital) (Zone-Empire)", name, n, year))
        .when(F.col("p_partkey") % 4 == 1, F.format_string("%s v%02d (%d) (digital)", name, n, year))
        .when(F.col("p_partkey") % 4 == 2, F.format_string("%s by Ann Lee Book %02d (%d)", name, n, year))
        .otherwise(F.format_string("%s (%d, 2nd edition) www.site.com", name, year))
    )
    return p.select("p_partkey", F.concat(F.lit("Comics/"), F.col("p_type"), F.lit("/"), stem, F.lit(".cbz")).alias("path"))


def event_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions on the source of a user."""
    e = table(spark, sf_dir, "events")
    kinds = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    field = F.when(F.col("event_id") % 2 == 0, "title").otherwise("publisher")
    payload = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit('{"cleared_fields":["'), field, F.lit('"]}'))).otherwise(F.concat(F.lit('{"overrides":{"'), field, F.lit('":"V'), F.col("event_id"), F.lit('"}}')))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("source_fingerprint"), F.concat(F.lit("cbz:"), F.col("user_id") % 7).alias("media_signature"), F.element_at(kinds, F.col("event_type")).alias("decision_type"), F.concat(F.lit("k"), F.col("event_id") % 5).alias("candidate_key"),
        F.concat(F.lit("e"), F.col("event_id") % 3).alias("source_evidence_hash"), F.concat(F.lit("d"), F.col("event_id") % 2).alias("candidate_data_hash"), F.when(F.col("event_type") == "click", payload).otherwise("{}").alias("payload_json"), F.col("ts").alias("created_at"), F.lit(None).cast("bigint").alias("supersedes_id"), F.lit(None).cast("string").alias("batch_id"),
    )


STATES = {"view": "pending", "click": "staging", "signup": "staged", "purchase": "complete", "error": "failed"}


def event_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journal rows of an item per user, in runs of ten items; each starts where the last one ended, but for every 13th."""
    e = table(spark, sf_dir, "events")
    from pyspark.sql.window import Window

    kinds = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    rows = e.select(F.col("event_id").alias("id"), F.floor(F.col("user_id") / 10).cast("string").alias("run_id"), F.col("user_id").cast("string").alias("item_id"), F.element_at(kinds, F.col("event_type")).alias("to_state"))
    before = F.lag("to_state").over(Window.partitionBy("run_id", "item_id").orderBy("id"))
    return rows.withColumn("from_state", F.when(F.col("id") % 13 == 0, "staged").otherwise(F.coalesce(before, F.lit("pending"))))


def journal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each item of the event journal."""
    from tallyweave.operators.history import latest

    return latest(event_journal(spark, sf_dir), ["run_id", "item_id"]).select("run_id", "item_id", F.col("to_state").alias("state"))


def line_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as members of an archive per order: a few links, folders, unsafe and colliding names among them."""
    from pyspark.sql.window import Window

    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = li.withColumn("entry_no", F.row_number().over(order).cast("int"))
    path = F.when(F.col("l_partkey") % 97 == 0, "../up.jpg").when(F.col("l_partkey") % 89 == 0, "Cover.JPG").when(F.col("l_partkey") % 83 == 0, "comicinfo.xml").otherwise(F.format_string("p%d_%d.jpg", "l_partkey", "entry_no"))
    return rows.select(
        F.col("l_orderkey").alias("archive_id"), "entry_no", path.alias("path"), F.col("l_quantity").cast("bigint").alias("size"), (F.col("l_partkey") % 5).cast("bigint").alias("compressed_size"), (F.col("l_partkey") % 41 == 0).alias("is_directory"), (F.col("l_partkey") % 61 == 0).alias("is_link"), F.lit(False).alias("is_encrypted"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"),
    )
