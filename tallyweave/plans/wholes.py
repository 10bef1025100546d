"""Registered queries over every branch of an operator: override rules, blocks, counters, recovery actions, feeds by row, package documents, ladders, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.sequence import sequence_struct
from tallyweave.operators import candidates, golden, plan, report, verify
from tallyweave.plans import bindings as b
from tallyweave.plans.fields import _pick
from tallyweave.plans.queries import query
from tallyweave.schemas import IDENTIFIERS
from tallyweave.sources import feeds, xml

_NONE = "CAST(NULL AS VARCHAR)"


def _none():
    return F.lit(None).cast("string")


# ---- override rules: a right and a wrong value of each field, and a field that cannot be edited

_FIELDS = ("isbn", "series_index", "run_start_year", "collection_volume", "date", "language", "item_type", "authors", "title", "colour")
_RIGHT = ("0-306-40615-2", "007", "1999", "3", "2020-02-29", "en-US", "Omnibus", " Ann , Bo Ray,", " T ", "red")
_WRONG = ("0306406153", " ", "1700", "0", "2021-02-29", "e", "poster", " , ", " ", "blue")


@query("""SELECT p_partkey, p_partkey // 10 % 2 = 0 AND p_partkey % 10 < 9 AS valid, CASE WHEN p_partkey // 10 % 2 = 0 THEN ['0306406152', '7', '1999', '3', '2020-02-29', 'en-US', 'omnibus', 'Ann,Bo Ray', 'T', NULL][p_partkey % 10 + 1] END AS resolved,
 CASE WHEN p_partkey % 10 = 9 THEN 'field is not editable: colour' WHEN p_partkey // 10 % 2 = 1 THEN ['invalid ISBN checksum', 'sequence number cannot be empty', 'run_start_year is outside the supported range', 'collection_volume must be a positive integer', 'invalid date', 'language must be a valid language tag', 'unsupported comic item type', 'at least one contributor is required', 'text cannot be empty'][p_partkey % 10 + 1] END AS error FROM part""")
def override_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(F.floor(k / 10) % 2 == 0, _pick(k % 10, *_RIGHT)).otherwise(_pick(k % 10, *_WRONG))
    rows = b.table(spark, sf_dir, "part").select("p_partkey", _pick(k % 10, *_FIELDS).alias("field"), value.alias("value"))
    return golden.validate_overrides(rows, 2026).select("p_partkey", "valid", "resolved", "error")


@query(f"""SELECT p_partkey, [{", ".join(repr(golden.BLOCKS[x]) for x in ("title", "creator", "series", "item_type"))}, '{golden.BLOCKS["unsupported"]}poster', {", ".join(repr(golden.BLOCKS[x]) for x in ("year", "sequence", "media"))}, ''][p_partkey % 9 + 1] AS blocks FROM part""")
def block_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as golden records that lack one thing each, and whole ones."""
    m = F.col("p_partkey") % 9
    kind = F.when(m < 2, "book").when(m == 7, "unknown").otherwise("comic")
    item = F.when(m == 4, "poster").when(m == 6, "annual").when((m > 4) | (m == 2), "issue")
    rows = b.table(spark, sf_dir, "part").select(
        "p_partkey", kind.alias("media_kind"), F.when(m != 0, F.col("p_name")).otherwise("").alias("title"), F.when(m == 1, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("creators"), F.when(m != 2, F.col("p_name")).alias("series_title"), item.alias("item_type"), F.when(m != 5, 2000).alias("run_start_year"), sequence_struct(F.when(m != 6, "1")).alias("sequence"),
    )
    return rows.select("p_partkey", F.array_join(golden.planning_blocks(), "; ").alias("blocks"))


# ---- counters

_SEEN = "WITH c AS (SELECT c_custkey AS k, c_nationkey % 3 > 0 AS found, c_acctbal > 5000 AS good, c_custkey % 4 = 0 AS hard, c_custkey % 3 AS av, c_custkey % 2 AS un, c_mktsegment = 'MACHINERY' AS coll FROM customer)"


@query(f"""{_SEEN} SELECT count(*) AS sources, count(*) FILTER (found) AS candidate_found, count(*) FILTER (NOT found) AS no_candidate, count(*) FILTER (found AND good) AS eligible_high_confidence, count(*) FILTER (found AND NOT good) AS review_required, count(*) FILTER (NOT found) AS unresolved, count(*) FILTER (av > 0) AS appropriate_provider_available,
 count(*) FILTER (NOT found AND av > 0) AS no_candidate_despite_provider_available, count(*) FILTER (av = 0) AS provider_unavailable, count(*) FILTER (av > 0 AND un > 0) AS partial_provider_unavailable, count(*) FILTER (k % 5 < 2 AND k % 7 < 4) AS work_accepted_edition_unresolved, count(*) FILTER (found AND hard) AS hard_contradictions,
 count(*) FILTER (coll) AS collected_editions, count(*) FILTER (coll AND found AND hard) AS collected_as_issue_contradictions FROM c""")
def match_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, found = F.col("c_custkey"), F.col("c_nationkey") % 3 > 0
    told = F.when(k % 4 == 0, F.array(F.lit("sequence numbers conflict"), F.lit("collected edition cannot resolve to a regular issue"))).otherwise(F.array().cast("array<string>"))
    items = b.table(spark, sf_dir, "customer").select(
        found.alias("has_candidate"), F.when(found, F.col("c_acctbal") > 5000).alias("eligible"), (k % 4 == 0).alias("hard_contradiction"), told.alias("contradictions"), (k % 3).alias("available"), (k % 2).alias("unavailable"), F.when(k % 5 < 2, "accepted").alias("work_state"), F.when(k % 7 < 4, "unresolved").otherwise("accepted").alias("edition_state"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "collected-edition").otherwise("issue").alias("subtype"),
    )
    return report.match_summary(items)


_CODES = ("unapproved", "rejected", "blocked", "stale_source", "run_changed", "skipped", "unresolved", "historical_missing")


@query("""WITH c AS (SELECT c_custkey % 11 AS m, c_custkey % 3 AS conflicts, c_custkey % 4 AS r FROM customer) SELECT count(*) FILTER (m > 7) AS included, count(*) FILTER (m > 7 AND r = 0) AS work_only, count(*) FILTER (m > 7 AND r = 1) AS manual, count(*) FILTER (m IN (0, 1)) AS unapproved, count(*) FILTER (m IN (2, 3, 4)) AS blocked, count(*) FILTER (m IN (5, 6)) AS skipped, CAST(coalesce(sum(conflicts) FILTER (m > 7), 0) AS BIGINT) AS conflicts FROM c""")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    conflicts = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (k % 3).cast("int"))
    rows = b.table(spark, sf_dir, "customer").select(F.when(k % 11 < 8, _pick(F.least(k % 11, F.lit(7)), *_CODES)).alias("code"), _pick(k % 4, "work_only", "manual", "complete", _none()).alias("resolution"), conflicts.alias("conflicts"))
    return plan.plan_counters(rows)


# ---- recovery: each state with a right, a wrong and no destination


@query("""WITH o AS (SELECT o_orderkey AS k, ['complete', 'committing', 'verified', 'committed', 'cleanup_pending', 'staging', 'failed', 'lost'][o_orderkey % 8 + 1] AS s, o_orderkey % 3 AS d FROM orders)
SELECT CAST(k AS VARCHAR) AS item_id, CASE WHEN s = 'complete' THEN 'none; item is complete' WHEN s = 'committing' AND d = 1 THEN 'recognize verified destination commit, then resume lifecycle' WHEN s IN ('verified', 'committing') AND d = 0 THEN 'publish retained verified staging output with no-clobber commit' WHEN s IN ('committed', 'cleanup_pending') AND d = 1 THEN 'resume or recognize planned source lifecycle'
 WHEN s IN ('staging', 'failed') THEN 'retry staging only if source and destination preconditions still hold' ELSE 'manual intervention required; no safe automatic transition is proven' END AS action, d > 0 AS destination_exists, CASE d WHEN 1 THEN true WHEN 2 THEN false END AS destination_matches FROM o""")
def recovery_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = b.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/d/"), k)
    state = _pick(k % 8, "complete", "committing", "verified", "committed", "cleanup_pending", "staging", "failed", "lost")
    items = o.select(F.lit("r").alias("run_id"), k.cast("string").alias("item_id"), state.alias("state"), path.alias("destination_path"), F.lit("/s").alias("source_path"), F.lit("/g").alias("staging_path"), F.lit("").alias("destination_hash"), F.lit("good").alias("staged_hash"), F.lit("s").alias("planned_source_hash"))
    there = o.where(k % 3 > 0).select(path.alias("path"), F.when(k % 3 == 1, "good").otherwise("bad").alias("sha256"))
    return verify.recovery_inspection(items, there).select("item_id", "action", "destination_exists", "destination_matches")


# ---- read-back by every rule


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN CASE WHEN p_partkey % 2 = 0 THEN 'not cleared' END WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'missing' ELSE 'differs' END END AS problem FROM part WHERE p_partkey % 2 = 0""")
def readback_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every kind, half of them written in another form that says the same, half of them wrong, lost or not cleared."""
    k = F.col("p_partkey")
    m = k % 7
    p = b.table(spark, sf_dir, "part")
    field = _pick(m, "date", "LanguageISO", "Volume", "isbn13", "title", "series_index", "Number")
    value = F.when(m != 6, _pick(F.least(m, F.lit(5)), "2020-05", "en_US", "7", "978-1", "T", "2.50"))
    expected = p.select("p_partkey", field.alias("field"), F.when(m == 6, "clear").otherwise("set").alias("op"), value.alias("value"))
    same, wrong = _pick(m, "2020-05-06", "EN", "07", "9781", "T", "2.5", ""), _pick(m, "2020-06-06", "fr", "8", "9782", "t", "3", "x")
    actual = p.where((k % 2 == 1) | (m == 6) | (k % 5 > 0)).select("p_partkey", field.alias("field"), F.when(k % 2 == 1, same).otherwise(wrong).alias("value"))
    return verify.metadata_readback(expected, actual, ["p_partkey"]).select("p_partkey", "problem")


# ---- feeds by row


@query("""SELECT event_id, CASE WHEN event_id % 7 > 0 THEN 'volume:e' || event_id || ':book_edition' END AS candidate_key, CASE WHEN event_id % 7 = 0 THEN 'malformed payload' END AS error FROM events""")
def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"items": [{"id": '), F.col("props"))).otherwise(F.concat(F.lit('{"items": [{"id": "e'), F.col("event_id"), F.lit('", "volumeInfo": {"title": "T"}}]}')))
    good, bad = feeds.normalize_volume_feed(b.table(spark, sf_dir, "events").select("event_id", payload.alias("payload")))
    kept = good.select(F.substring("provider_id", 2, 20).cast("bigint").alias("event_id"), "candidate_key", _none().alias("error"))
    return kept.unionByName(bad.select("event_id", _none().alias("candidate_key"), "error"))


@query("""SELECT event_id, CASE WHEN epoch(ts) <= epoch(TIMESTAMP '2024-01-05') THEN 'miss' WHEN user_id % 3 = 2 AND user_id % 2 = 0 THEN 'reuse' ELSE 'redo' END AS part FROM events""")
def renormalised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = b.table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 2, 2).otherwise(1).alias("schema_version"), F.when(F.col("user_id") % 2 == 0, 2).otherwise(1).alias("candidate_version"), F.col("ts").cast("timestamp").cast("double").alias("expires_at"))
    reuse, redo, miss = (df.select("event_id", F.lit(n).alias("part")) for df, n in zip(feeds.renormalize(cache, 2, 1704412800.0), ("reuse", "redo", "miss"), strict=True))
    return reuse.union(redo).union(miss)


@query(f"""SELECT 'work:OL' || s_suppkey || 'M:book_edition' AS candidate_key, s_name || ' II' AS title, 'Ann' AS creator, 'isbn:' || s_suppkey AS identifiers, CASE WHEN s_suppkey % 2 = 0 THEN 'House' END AS publisher, '1999' AS publication_date, 'works/OL' || s_suppkey || 'W' AS work_id, 'OL' || s_suppkey || 'M' AS edition_id, {_NONE} AS language FROM supplier WHERE s_suppkey % 3 > 0""")
def work_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as works with one edition, one without a title, and one whose key is no edition's."""
    k = F.col("s_suppkey")
    edition = lambda key, title: F.struct(key.alias("key"), title.alias("title"), F.array(k.cast("string")).alias("isbn"), F.when(k % 2 == 0, F.array(F.lit("House"))).alias("publisher"), F.array(F.lit("1999")).alias("publish_date"))
    name = F.concat("s_name", F.lit(" II"))
    some = F.array(edition(F.concat(F.lit("/books/OL"), k, F.lit("M")), F.when(k % 3 > 0, name)), edition(F.concat(F.lit("/works/OL"), k, F.lit("W")), name))
    doc = F.struct(F.concat(F.lit("/works/OL"), k, F.lit("W")).alias("key"), F.col("s_name").alias("title"), F.array(F.lit("Ann")).alias("author_name"), F.struct(some.alias("docs")).alias("editions"))
    got, _ = feeds.normalize_work_feed(b.table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.array(doc).alias("docs"))).alias("payload")), editions=True)
    ids = F.array_join(F.transform("identifiers", lambda x: F.concat_ws(":", x["scheme"], x["value"])), "|")
    return got.select("candidate_key", "title", F.get("creators", F.lit(0))["name"].alias("creator"), ids.alias("identifiers"), "publisher", "publication_date", "work_id", "edition_id", "language")


# ---- package documents: roles by attribute and by refinement, series by collection and by name, and broken ones


@query("""SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'Page ' || page_id END AS title, CASE WHEN page_id % 4 < 3 THEN 'House' END AS publisher, CASE WHEN page_id % 4 < 3 THEN '2020-01' END AS date, CASE WHEN page_id % 4 < 3 THEN 'en' END AS language, CASE WHEN page_id % 4 = 0 THEN 'About & more' END AS description, CASE WHEN page_id % 4 < 3 THEN CASE page_id % 4 WHEN 1 THEN 'A ' || page_id ELSE 'A ' || page_id || '|B' END END AS creators,
 CASE page_id % 4 WHEN 0 THEN 'aut=A ' || page_id || ',B;trl=T' WHEN 1 THEN 'aut=A ' || page_id || ';edt=B;trl=T' WHEN 2 THEN 'aut=A ' || page_id || ',B;trl=T' END AS contributors, CASE WHEN page_id % 4 < 3 THEN 's1|s2' END AS subjects, CASE WHEN page_id % 4 < 3 THEN 'urn:' || page_id END AS identifiers,
 CASE page_id % 4 WHEN 0 THEN 'Old' WHEN 1 THEN 'New' END AS series, CASE page_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '2.5' END AS series_index, CASE WHEN page_id % 4 = 3 THEN 'malformed package document' END AS xml_error FROM pages""")
def package_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    m = k % 4
    head = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata>'
    second = F.when(m == 1, '<dc:creator id="b">B</dc:creator><meta property="role" refines="#b">edt</meta>').otherwise("<dc:creator> B </dc:creator>")
    series = F.when(m == 0, '<meta name="calibre:series" content="Old"/><meta name="calibre:series_index" content="3"/>').when(m == 1, '<meta property="belongs-to-collection" id="c">New</meta><meta property="group-position" refines="#c">2.5</meta><meta name="calibre:series" content="Old"/>').otherwise("")
    doc = F.concat(
        F.lit(head), F.lit("<dc:title>Page "), k, F.lit("</dc:title><dc:publisher>House</dc:publisher><dc:date>2020-01</dc:date><dc:language>en</dc:language>"), F.when(m == 0, "<dc:description>About &amp; more</dc:description>").otherwise(""), F.lit('<dc:creator opf:role="aut">A '), k, F.lit("</dc:creator>"), second,
        F.lit('<dc:contributor opf:role="trl">T</dc:contributor><dc:subject>s1</dc:subject><dc:subject> s2 </dc:subject><dc:subject> </dc:subject><dc:identifier>urn:'), k, F.lit("</dc:identifier>"), series, F.when(m == 3, "").otherwise("</metadata></package>"),
    )
    got = xml.opf_fields(b.table(spark, sf_dir, "pages").select("page_id", doc.alias("xml")))
    groups = F.array_join(F.array_sort(F.transform(F.map_entries("contributors"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))), ";")
    return got.select("page_id", "title", "publisher", "date", "language", "description", F.array_join("creators", "|").alias("creators"), groups.alias("contributors"), F.array_join("subjects", "|").alias("subjects"), F.array_join("identifiers", "|").alias("identifiers"), "series", "series_index", "xml_error")


# ---- query ladders with their titles


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS source_id, upper(left(p_name, 1)) || substr(p_name, 2) AS s, p_size AS n, p_brand AS c, ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen', 'twenty'] AS w FROM part),
r AS (SELECT source_id, c, unnest([{'label': 'structured', 'title': s || ' Volume ' || n}, {'label': 'vol', 'title': s || ' Vol. ' || n}, {'label': 'vol-comma', 'title': s || ', Vol. ' || n}]) AS x FROM p),
i AS (SELECT source_id, 'creator-inline' AS label, s || ' by ' || c || ' Volume ' || n AS title, c AS creators FROM p UNION ALL SELECT source_id, 'creator-inline-word-number', s || ' by ' || c || ' Volume ' || upper(left(w[n], 1)) || substr(w[n], 2), c FROM p WHERE n <= 20)
SELECT source_id, x.label AS label, x.title AS title, c AS creators FROM r UNION ALL SELECT source_id, x.label || '-title-only', x.title, '' FROM r UNION ALL SELECT * FROM i""")
def ladder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as collected editions: a variant of the title with and without creators each."""
    size = (F.col("year") - 2000).cast("string")
    local = b.part_locals(spark, sf_dir).withColumn("kind", F.lit("comic")).withColumn("subtype", F.lit(candidates.COLLECTED))
    local = local.withColumn("series_title", F.concat(F.upper(F.substring("title", 1, 1)), F.expr("substr(title, 2)"))).withColumn("title", F.concat(F.lit("Volume "), size)).withColumn("sequence", sequence_struct(size))
    return candidates.collection_ladder(local).select("source_id", "label", "title", F.array_join("creators", "|").alias("creators"))


# ---- tiers: a third of the sources have an identifier, a third a title, a third a few words of one


@query("""WITH p AS (SELECT *, p_partkey % 3 AS m FROM part) SELECT CAST(p_partkey AS VARCHAR) AS source_id, 'work:' || p_partkey || ':book_work' AS candidate_key, 'identifier:isbn' AS strategy FROM p WHERE m = 0
UNION ALL SELECT CAST(a.p_partkey AS VARCHAR), 'work:' || c.p_partkey || ':book_work', 'structured' FROM p a JOIN part c USING (p_name, p_brand) WHERE a.m = 1 UNION ALL SELECT CAST(a.p_partkey AS VARCHAR), 'work:' || c.p_partkey || ':book_work', 'relaxed' FROM p a JOIN part c USING (p_name) WHERE a.m = 2""")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, found = b.part_locals(spark, sf_dir), b.part_candidates(spark, sf_dir)
    m = F.col("source_id").cast("bigint") % 3
    isbn = lambda c: F.array(F.struct(F.lit("ISBN").alias("scheme"), c.alias("value"))).cast(IDENTIFIERS)
    local = local.withColumn("title", F.when(m == 2, F.concat("title", F.lit(" zz"))).otherwise(F.col("title"))).withColumn("identifiers", F.when(m == 0, isbn(F.col("source_id"))).otherwise(F.col("identifiers")))
    routes = local.select("source_id", F.lit("work").alias("provider"), F.lit("search").alias("outcome"))
    return candidates.tiered_pairs(local, found.withColumn("identifiers", isbn(F.col("provider_id"))), routes).select("source_id", "candidate_key", "strategy")
