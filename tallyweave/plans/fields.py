"""Registered queries of pair scoring by every rule, of single-field functions, and of scopes and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.functions.sequence import sequence_struct
from tallyweave.operators import candidates, compare, plan, rank, report
from tallyweave.plans import bindings as b
from tallyweave.plans.queries import query
from tallyweave.schemas import CREDITS, IDENTIFIERS
from tallyweave.sources import inventory

# ---- pair scoring: each part is a local comic and its own candidate, altered by its number, so that every outcome of every rule occurs


def _pick(n: Column, *values: object) -> Column:
    """The value at place ``n``."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (n + 1).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("k")
    p = b.spread(b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 2 == 1).alias("collected")), "k")
    at = lambda div, mod: F.floor(k / div) % mod
    none = lambda kind: F.lit(None).cast(kind)
    name, other = F.lit("abcdefghij"), _pick(at(2, 4), "abcdefghij", "abcdefghix", "abcdefghxy", "zwvutsrqpo")
    ident = lambda v: F.when(at(8, 5) < 2, F.array(F.struct(F.lit("UPC").alias("scheme"), v.alias("value")))).otherwise(F.array()).cast(IDENTIFIERS)
    number = lambda v: sequence_struct(F.when(at(3, 3) > 0, v))
    local = p.select(
        k.cast("string").alias("source_id"), F.lit("comic").alias("kind"), F.when(F.col("collected"), "collected-edition").otherwise("issue").alias("subtype"), F.lit(0.98).alias("classification_confidence"),
        F.when(F.col("collected"), name).when(at(2, 3) < 2, F.lit("klmn")).alias("title"), F.when(at(4, 3) > 0, F.array(F.lit("Ann Lee"))).otherwise(text.no_texts()).alias("creators"), ident(F.lit("123")).alias("identifiers"), F.when(~F.col("collected"), name).alias("series_title"),
        number(F.lit("7")).alias("sequence"), F.lit(2000).alias("year"), F.when(at(7, 3) > 0, 1990).alias("run_start_year"), F.when(at(5, 3) > 0, "abcd").alias("publisher"), none("string").alias("language"), F.when(F.col("collected") & (at(6, 4) > 0), F.array(F.lit("Omnibus"))).otherwise(text.no_texts()).alias("edition_qualifiers"),
    )
    date = (F.lit(2000) + _pick(at(9, 3), 0, 1, 5)).cast("string")
    found = p.select(
        F.concat(F.lit("c:"), k).alias("candidate_key"), F.lit("c").alias("provider"), k.cast("string").alias("provider_id"), F.when(F.col("collected"), "comic_collection").otherwise("comic_issue").alias("record_type"), F.lit("comic").alias("media_kind"), F.when(F.col("collected"), other).otherwise(_pick(at(2, 3), "klmn", "opqr", "klmn")).alias("title"),
        _pick(at(6, 4), none("string"), "Omnibus", "Hardcover", none("string")).alias("subtitle"), F.array(F.struct(_pick(at(4, 3), "Ann Lee", "ANN LEE", "Bo Ray").alias("name"), F.lit("writer").alias("role"))).cast(CREDITS).alias("creators"), ident(_pick(at(8, 5), "123", "456", "", "", "")).alias("identifiers"), _pick(at(5, 3), "abcd", "abcd", "wxyz").alias("publisher"),
        date.alias("publication_date"), none("string").alias("release_date"), none("string").alias("release_date_precision"), F.concat(date, F.lit("-03")).alias("cover_date"), *(none("string").alias(c) for c in ("cover_date_precision", "language")), F.when(~F.col("collected"), other).alias("series_title"), _pick(at(7, 3), 1990, 1990, 1994).alias("run_start_year"),
        number(_pick(at(3, 3), "7", "7", "8")).alias("sequence"), *(none("string").alias(c) for c in ("item_type", "work_id", "edition_id", "run_id")), F.create_map().cast("map<string, string>").alias("provider_metadata"), F.lit(1).alias("provider_schema_version"),
    )
    return local, found


_RULES = """WITH p AS (SELECT p_partkey AS k, p_partkey % 2 = 1 AS collected FROM part), d AS (SELECT k,
  CASE k // 8 % 5 WHEN 0 THEN 55 WHEN 1 THEN -100 END AS identifier, CASE k // 2 % 4 WHEN 0 THEN 32 WHEN 1 THEN 22 WHEN 2 THEN 8 ELSE -18 END AS title,
  CASE WHEN NOT collected AND k // 2 % 3 = 0 THEN 12 WHEN NOT collected AND k // 2 % 3 = 1 THEN -8 END AS issue_title, CASE k // 4 % 3 WHEN 1 THEN 18 WHEN 2 THEN -12 END AS creators,
  CASE WHEN collected AND k // 5 % 3 = 1 THEN 8 WHEN collected AND k // 5 % 3 = 2 THEN -20 END AS publisher, CASE WHEN collected THEN CASE k // 6 % 4 WHEN 1 THEN 18 WHEN 2 THEN -30 WHEN 3 THEN -20 END END AS edition_qualifier,
  CASE k // 3 % 3 WHEN 1 THEN 30 WHEN 2 THEN -100 END AS sequence, CASE k // 9 % 3 WHEN 0 THEN CASE WHEN collected THEN 20 ELSE 8 END WHEN 1 THEN CASE WHEN collected THEN 2 ELSE 3 END ELSE CASE WHEN collected THEN -35 ELSE -7 END END AS year,
  CASE k // 7 % 3 WHEN 1 THEN 8 WHEN 2 THEN -10 END AS run_start_year FROM p)"""
_FIELDS = ("identifier", "title", "issue_title", "creators", "publisher", "edition_qualifier", "sequence", "year", "run_start_year")


def _compared(spark: SparkSession, sf_dir: str, exchange: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parts with their candidates by class, and the scores of the classes that meet."""
    local, found = _parts(spark, sf_dir)
    blocked = found.select(F.col("provider_id").alias("source_id"), "candidate_key", F.lit("own").alias("strategy"))
    return rank.paired_scores(local, found, blocked, exchange)


@query(f"""{_RULES} SELECT CAST(k AS VARCHAR) AS source_id, CAST(greatest(0, least(100, 40 + {" + ".join(f"coalesce({f}, 0)" for f in _FIELDS)})) AS DOUBLE) AS score, coalesce(identifier = -100, false) OR coalesce(sequence = -100, false) AS hard_contradiction FROM d""")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, scores = _compared(spark, sf_dir)
    return members.join(scores.select("a", "b", "score", "hard_contradiction"), ["a", "b"]).select("source_id", "score", "hard_contradiction")


@query(f"""{_RULES}, u AS (UNPIVOT d ON {", ".join(_FIELDS)} INTO NAME field VALUE delta) SELECT field, CAST(delta AS DOUBLE) AS score_delta, count(*) AS n FROM u GROUP BY field, delta""")
def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, scores = _compared(spark, sf_dir)
    sizes = members.groupBy("a", "b").agg(F.count("*").alias("n"))
    rows = scores.select("a", "b", F.explode("comparisons").alias("x")).join(sizes, ["a", "b"])
    return rows.groupBy("x.field", "x.score_delta").agg(F.sum("n").alias("n"))


# ---- files: documents as files of five kinds, every seventh unreadable


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'a.epub' ELSE 'a.cbz' END AS name, CAST(CASE doc_id % 5 WHEN 0 THEN from_hex('255044462D') WHEN 1 THEN from_hex('504B0304') WHEN 2 THEN from_hex('504B0506') WHEN 3 THEN from_hex('526172211A0700') ELSE from_hex('00') END AS BLOB) || encode(coalesce(text, '')) AS content FROM documents)
SELECT doc_id || '/' || name AS path, CASE WHEN doc_id % 7 = 0 THEN '' ELSE sha256(content) END AS sha256, CASE WHEN doc_id % 7 = 0 THEN 'unreadable' ELSE ['pdf', 'zip', 'zip-epub', 'rar', 'unknown'][doc_id % 5 + 1] END AS signature,
 CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE ['pdf', 'cbz', 'epub', 'cbr', 'unknown'][doc_id % 5 + 1] END AS format FROM f""")
def file_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _pick(F.col("doc_id") % 5, *(F.unhex(F.lit(h)) for h in ("255044462D", "504B0304", "504B0506", "526172211A0700", "00")))
    path = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 2, "/a.epub").otherwise("/a.cbz"))
    files = b.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.concat(heads, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    read = inventory.with_sha256(inventory.with_signature(files.where(F.col("doc_id") % 7 != 0))).drop("doc_id")
    return inventory.with_failures(files.select("path"), read).select("path", "sha256", "signature", "format")


# ---- single fields


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN NULL ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Ann Lee|Bo Ray' WHEN 3 THEN 'Ann, Bo Ray; C' END AS names,
 CASE p_partkey % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Ann Lee|Bo Ray' WHEN 2 THEN 'Prince' ELSE 'Ann|Bo Ray|C' END AS listed FROM part""")
def split_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _pick(F.col("p_partkey") % 4, "Ann Lee", "Ann Lee & Bo Ray", "Prince", "Ann, Bo Ray; C")
    rows = b.table(spark, sf_dir, "part").select("p_partkey", by.alias("by"), text.credit(F.concat("p_name", F.lit(" by "), by)).alias("credit"))
    return rows.select("p_partkey", "credit.title", F.array_join("credit.names", "|").alias("names"), F.array_join(text.split_names(F.col("by")), "|").alias("listed"))


@query("""SELECT p_partkey, 'brand ' || split_part(p_brand, '#', 2) || CASE p_partkey % 3 WHEN 2 THEN ' press' ELSE '' END AS publisher, regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') || [' volume 4', ' book 12', ' volume 7', ''][p_partkey % 4 + 1] AS title FROM part""")
def publisher_and_collection_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    house = F.concat("p_brand", _pick(F.col("p_partkey") % 3, " Publishing, Inc.", " COMICS", " Press"))
    title = F.concat("p_name", _pick(F.col("p_partkey") % 4, ", Vol. IV", " - Book #Twelve", ": Volume 07", "!"))
    return b.table(spark, sf_dir, "part").select("p_partkey", text.publisher_key(house).alias("publisher"), text.collection_title_key(title).alias("title"))


@query("""SELECT p_partkey, ['Omnibus', 'Deluxe Edition|Hardcover', '', '2nd Edition'][p_partkey % 4 + 1] AS families FROM part""")
def edition_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_name", _pick(F.col("p_partkey") % 4, " Omnibus", " (Hardcover, Deluxe  Edition)", "", ": 2nd Edition"))
    sub = _pick(F.col("p_partkey") % 4, "an OMNIBUS", F.lit(None).cast("string"), "plain", "")
    return b.table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.edition_qualifiers(title, sub), "|").alias("families"))


# ---- orders and scopes


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5""")
def largest_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.capped(b.table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.newest(b.table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 20).select("o_orderkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def scoped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = b.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    orders = report.in_scope(b.table(spark, sf_dir, "orders"), customers.where("c_nationkey < 10"), "o_custkey")
    return report.out_of_scope(orders, customers.where("c_acctbal < 0"), "o_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey AS item_id, 'p' || l_partkey || '.cbz' AS destination_path FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)""")
def taken_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("p"), F.col(c), F.lit(".cbz"))
    items = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), path("l_partkey").alias("destination_path"))
    there = b.table(spark, sf_dir, "part").where("p_size < 20").select(path("p_partkey").alias("path"))
    return plan.existing_paths(items, there).select("item_id", "destination_path")


@query("""WITH r AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('O', 'P')), t AS (SELECT max(epoch(ts)) AS now FROM events)
SELECT (SELECT count(*) FROM r) AS active_runs, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT id FROM r) AND l_linestatus <> 'F') AS open_items, (SELECT count(*) FROM events, t WHERE epoch(ts) > now - 3600) AS recent_requests""")
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, their lines as items, events as requests; the time is that of the last event."""
    status = F.create_map(*(F.lit(x) for x in ("O", "running", "P", "recovery_required", "F", "complete")))
    runs = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(status, F.col("o_orderstatus")).alias("status"))
    items = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linestatus") == "F", "complete").otherwise("pending").alias("state"))
    requests = b.table(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("reserved_at"))
    return report.attention(runs, items, requests, requests.agg(F.max("reserved_at")).first()[0] or 0.0)
