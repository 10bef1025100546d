"""Registered queries of what is read and written: folders, exports, metadata documents, united arrays, manual records, destinations, plans that may run."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.functions.sequence import sequence_struct
from tallyweave.operators import candidates, golden, plan, project, rank
from tallyweave.plans import bindings as b
from tallyweave.plans.fields import _pick
from tallyweave.plans.queries import query
from tallyweave.sources import feeds, inventory, sinks, xml


def _joined(c: str):
    return F.array_join(c, "|")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all tasks share: below ``spark.checkpoint.dir``, on one machine without it a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), f"tallyweave-{os.getpid()}")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- a folder of files, written from documents and scanned


def _write_files(rows: DataFrame, root: str) -> None:
    """(path, content) as files under a mounted folder."""

    def write(part) -> None:
        for r in part:
            target = os.path.join(root, r.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.{os.getpid()}", "wb") as f:  # whole under its name, also if the task is tried again
                f.write(r.content)
            os.replace(f.name, target)

    rows.foreachPartition(write)


@query("""WITH f AS (SELECT coalesce(lang, 'none') || '/' || source || '/' || doc_id || ['.cbz', '.pdf', '.txt', '.epub'][doc_id % 4 + 1] AS path, CAST(from_hex(['504B0304', '255044462D', '00', '00'][doc_id % 4 + 1]) AS BLOB) || encode(coalesce(text, '')) AS content, doc_id % 4 AS m, lang FROM documents)
SELECT path, CAST(octet_length(content) AS BIGINT) AS size, sha256(content) AS sha256, ['zip', 'pdf', '', 'unknown'][m + 1] AS signature, ['cbz', 'pdf', '', 'unknown'][m + 1] AS format, CAST(NULL AS VARCHAR) AS error FROM f WHERE m <> 2 AND coalesce(lang, 'none') <> 'es'""")
def scanned_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of four kinds, one of them no media; a language's folder is excluded, and a link to another folder is skipped."""
    root = _folder(spark, "files").removeprefix("file://")
    m = F.col("doc_id") % 4
    name = F.concat("doc_id", _pick(m, ".cbz", ".pdf", ".txt", ".epub"))
    content = F.concat(_pick(m, *(F.unhex(F.lit(h)) for h in ("504B0304", "255044462D", "00", "00"))), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    _write_files(b.table(spark, sf_dir, "documents").select(F.concat_ws("/", F.coalesce("lang", F.lit("none")), "source", name).alias("path"), content.alias("content")), root)
    os.symlink(root, os.path.join(root, "again"))
    rows = inventory.scanned(spark, root, [os.path.join(root, "es")], folders=8)
    return rows.select(F.substring("path", len(root) + 2, 1 << 20).alias("path"), "size", "sha256", "signature", "format", "error")


# ---- exports of plans: a whole one, and one to which a file was added

_DOCS = """d AS (SELECT '{"schema_version":' || CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '9' END || ',"planning_policy":{"version":"2","k":"' || o_orderkey || '"},"items":[]}' AS doc, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'unsupported schema version|unsafe permission modes' END AS reasons FROM orders)"""


@query(f"""WITH {_DOCS} SELECT 'whole' AS export, sha256(doc) AS sha256, coalesce(reasons, '') AS reasons FROM d UNION ALL SELECT 'torn', sha256(doc), concat_ws('|', reasons, 'torn export') FROM d UNION ALL SELECT 'torn', sha256('{{"schema_version":1,"items":[]}}'), 'torn export'""")
def plan_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    doc = F.concat(F.lit('{"schema_version":'), F.when(k % 2 == 0, "1").otherwise("9"), F.lit(',"planning_policy":{"version":"2","k":"'), k, F.lit('"},"items":[]}'))
    plans = b.table(spark, sf_dir, "orders").select(doc.alias("canonical_json"))
    root, got = _folder(spark, "plans"), []
    for name in ("whole", "torn"):
        sinks.export_plans(plans, f"{root}/{name}")
        if name == "torn":
            plans.limit(1).select(F.lit('{"schema_version":1,"items":[]}').alias("value")).write.mode("append").text(f"{root}/{name}/data")
        got += [df.select(F.lit(name).alias("export"), "sha256", _joined("reasons").alias("reasons")) for df in sinks.import_plans(spark, f"{root}/{name}")]
    return got[0].union(got[1]).union(got[2]).union(got[3])


@query("""SELECT 'r' || (o_custkey % 2) AS run_id, CAST(o_custkey AS VARCHAR) AS source_id, 'k' || o_orderkey AS candidate_key, CAST(o_orderkey % 100 AS DOUBLE) AS score, '[{"field":"title","score_delta":' || (o_orderkey % 100) || '.0}]' AS comparisons FROM orders""")
def written_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of two runs, the first written again, read back."""
    k = F.col("o_orderkey")
    score = (k % 100).cast("double")
    rows = b.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_custkey").cast("string").alias("source_id"), F.concat(F.lit("k"), k).alias("candidate_key"), F.lit(1).alias("rank"), score.alias("score"), F.lit(0.0).alias("runner_up_margin"), F.lit(True).alias("eligible"), F.lit(False).alias("hard_contradiction"), F.array(F.struct(F.lit("title").alias("field"), score.alias("score_delta"))).alias("comparisons"))
    path = _folder(spark, "scores")
    for run in (0, 1, 0):
        sinks.write_scores(rows.where(F.col("o_custkey") % 2 == run), path, f"r{run}")
    return spark.read.parquet(path).select("run_id", "source_id", "candidate_key", "score", "comparisons")


# ---- comic metadata: all fields, and every error


@query("""WITH d AS (SELECT doc_id, source, doc_id % 6 AS m, ['Title', 'Series', 'Number', 'Volume', 'Format', 'Year', 'Month', 'Day', 'Writer', 'Penciller', 'Inker', 'Colorist', 'Letterer', 'CoverArtist', 'Editor', 'Translator', 'Publisher', 'Imprint', 'LanguageISO', 'GTIN'] AS f FROM documents)
SELECT doc_id, concat_ws('|', CASE m WHEN 0 THEN NULL ELSE '' END, array_to_string(list_transform(list_filter(f, lambda x, i: m IN (0, 1) AND (doc_id + i) % 3 > 0), lambda x: x || '=' || x || ' & <' || doc_id || '>'), '|')) AS fields,
 CASE m WHEN 2 THEN 'malformed XML' WHEN 3 THEN 'wrong root element' WHEN 4 THEN 'duplicate field: Series' WHEN 5 THEN 'malformed XML' END AS xml_error FROM d""")
def comicinfo_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two of three fields, with white space around their texts; malformed, with another root, with a field twice, and null ones."""
    m = F.col("doc_id") % 6
    field = lambda n, name: F.when((F.col("doc_id") + n) % 3 > 0, F.concat(F.lit(f"<{name}> "), xml.text_of(F.concat(F.lit(f"{name} & <"), "doc_id", F.lit(">"))), F.lit(f" </{name}>"))).otherwise(F.when((F.col("doc_id") + n) % 2 > 0, f"<{name}/>").otherwise(""))
    body = F.concat(*(field(n, name) for n, name in enumerate(xml.COMIC_FIELDS, 1)), F.lit("<Pages><Page Image='0'/></Pages>"))
    doc = F.when(m < 2, F.concat(F.lit("<?xml version='1.0'?><!-- x --><ComicInfo>"), body, F.lit("</ComicInfo>"))).when(m == 2, F.concat(F.lit("<ComicInfo>"), body)).when(m == 3, "<Other><Title>x</Title></Other>").when(m == 4, "<ComicInfo><Series>a</Series><Title>b</Title><Series>a</Series></ComicInfo>")
    got = xml.comicinfo_fields(b.table(spark, sf_dir, "documents").select("doc_id", doc.alias("xml")))
    told = F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f"{f}="), F.col(f)) for f in xml.COMIC_FIELDS))), "|")
    return got.select("doc_id", F.when(m == 0, told).otherwise(F.concat(F.lit("|"), told)).alias("fields"), "xml_error")


@query("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'work:works/OL' || s_suppkey || 'W:book_work' ELSE 'work:OL' || s_suppkey || 'M:book_edition' END AS candidate_key, s_name AS title, CASE WHEN s_suppkey % 3 > 0 THEN 'isbn:' || s_suppkey || '|isbn:978' || s_suppkey ELSE '' END AS identifiers, CASE WHEN s_suppkey % 3 > 0 THEN 'House' END AS publisher,
 CASE WHEN s_suppkey % 3 > 0 THEN 'May 1999' ELSE '1987' END AS publication_date, CASE WHEN s_suppkey % 3 > 0 THEN 'eng' END AS language, CASE WHEN s_suppkey % 3 = 0 THEN 'works/OL' || s_suppkey || 'W' ELSE 'works/OL7W' END AS work_id, CASE WHEN s_suppkey % 3 > 0 THEN 'OL' || s_suppkey || 'M' END AS edition_id FROM supplier WHERE s_suppkey % 5 > 0""")
def edition_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as single documents of works and editions; every fifth lacks its title."""
    k = F.col("s_suppkey")
    edition = k % 3 > 0
    key = F.when(edition, F.concat(F.lit("/books/OL"), k, F.lit("M"))).otherwise(F.concat(F.lit("/works/OL"), k, F.lit("W")))
    doc = F.struct(
        key.alias("key"), F.when(k % 5 > 0, F.col("s_name")).alias("title"), F.lit("first in 1987").alias("first_publish_date"), F.array(F.lit("House")).alias("publishers"), F.lit("May 1999").alias("publish_date"), F.array(k.cast("string"), F.lit("")).alias("isbn_10"), F.array(F.concat(F.lit("978"), k)).alias("isbn_13"),
        F.array(F.struct(F.lit("/languages/eng").alias("key"))).alias("languages"), F.array(F.struct(F.lit("/works/OL7W").alias("key"))).alias("works"),
    )
    got, _ = feeds.normalize_edition_feed(b.table(spark, sf_dir, "supplier").select(F.to_json(doc).alias("payload")))
    ids = F.array_join(F.transform("identifiers", lambda x: F.concat_ws(":", x["scheme"], x["value"])), "|")
    return got.select("candidate_key", "title", ids.alias("identifiers"), "publisher", "publication_date", "language", "work_id", "edition_id")


# ---- arrays united in the order of first appearance

_LINES = "v AS (SELECT l_orderkey AS k, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag END || l_partkey % 3 AS v, 'S' || l_suppkey % 5 AS name, ['writer', 'Penciller', 'script', 'cover artist', 'designer', '', 'WRITER'][l_linenumber % 7 + 1] AS role FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    role = _pick(n % 7, "writer", "Penciller", "script", "cover artist", "designer", "", "WRITER")
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.concat(F.when(n % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")), F.col("l_partkey") % 3).alias("v"), F.concat(F.lit("S"), F.col("l_suppkey") % 5).alias("name"), role.alias("role"))


@query(f"""WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY k, lower(v) ORDER BY a, b, c, v) AS n FROM v) SELECT k AS l_orderkey, string_agg(v, '|' ORDER BY a, b, c, v) AS flags FROM r WHERE n = 1 GROUP BY k""")
def ordered_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = golden.ordered_distinct(_lines(spark, sf_dir), ["l_orderkey"], ["a", "b", "c"], {"v": F.col("v")}, ("v",))
    return got.select("l_orderkey", F.array_join(F.transform("items", lambda x: x["v"]), "|").alias("flags"))


@query(f"""WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY k, lower(name), lower(role) ORDER BY a, b, c, name, role) AS n FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, b, c, name, role) AS i, CASE lower(role) WHEN 'writer' THEN 'writers' WHEN 'script' THEN 'writers' WHEN 'penciller' THEN 'pencillers' WHEN 'cover artist' THEN 'cover_artists' WHEN '' THEN 'unknown:creator' ELSE 'unknown:' || role END AS g FROM r WHERE n = 1),
e AS (SELECT k, g, name, min(i) AS i FROM o GROUP BY ALL), x AS (SELECT k, g, min(i) AS i, g || '=' || string_agg(name, ',' ORDER BY i) AS t FROM e GROUP BY k, g)
SELECT k AS l_orderkey, (SELECT string_agg(name || ':' || role, '|' ORDER BY i) FROM o WHERE o.k = x.k) AS creators, string_agg(t, ';' ORDER BY i) AS contributors FROM x GROUP BY k""")
def united_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = golden.united_credits(_lines(spark, sf_dir), ["l_orderkey"], ["a", "b", "c"])
    names = F.array_join(F.transform("creators", lambda x: F.concat_ws(":", x["name"], x["role"])), "|")
    groups = F.array_join(F.transform(F.map_entries("contributors"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return got.select("l_orderkey", names.alias("creators"), groups.alias("contributors"))


# ---- manual records


@query("""SELECT CAST(user_id AS VARCHAR) AS source_fingerprint, event_id AS id, 'T' || event_id AS title, 'Ann|Bo Ray' AS creators, CAST(event_id % 10 AS VARCHAR) AS sequence, CASE WHEN event_id % 3 > 0 THEN CAST(1999 AS INTEGER) END AS run_start_year, 'isbn13=978' || event_id AS identifiers, 'decision_id=' || event_id || '|decision_type=manual_identity' AS provenance FROM events WHERE event_type = 'click'""")
def manual_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = F.create_map(F.lit("title"), F.concat(F.lit("T"), "id"), F.lit("authors"), F.lit("Ann, Bo Ray,"), F.lit("sequence"), F.concat(F.lit("0"), F.col("id") % 10), F.lit("run_start_year"), F.when(F.col("id") % 3 > 0, "1999").otherwise("soon"), F.lit("isbn13"), F.concat(F.lit("978"), "id"))
    rows = b.event_decisions(spark, sf_dir).where("decision_type = 'manual_override'").withColumn("decision_id", F.col("id")).withColumn("media_kind", F.lit("book")).withColumn("payload_json", F.to_json(F.struct(identity.alias("identity"))))
    told = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    got = golden.resolve_manual(rows)
    return got.select("source_fingerprint", F.col("provenance")["decision_id"].cast("bigint").alias("id"), "title", _joined("creators").alias("creators"), F.col("sequence.normalized").alias("sequence"), "run_start_year", told("identifiers").alias("identifiers"), told("provenance").alias("provenance"))


# ---- collections adapted to local ones


@query("""SELECT 'c' || p_partkey AS candidate_key, 'comic_collection' AS record_type, CASE p_partkey % 3 WHEN 0 THEN 'Ann Lee:writer|Cy:editor' ELSE 'Ann Lee:author|Big Press:author|Cy:editor' END AS creators, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE 'Theirs' END AS series_title, '2' AS sequence,
 CASE p_partkey % 3 WHEN 0 THEN 'collected-edition' ELSE 'omnibus' END AS item_type, CASE p_partkey % 3 WHEN 0 THEN 'raw=1|collection_series_source=local|collection_sequence_source=provider_title|collection_adapter=book_edition|collection_source_record_type=book_edition|collection_organization_contributors=Big Press' ELSE 'raw=1|collection_series_source=provider|collection_sequence_source=provider' END AS metadata FROM part WHERE p_partkey % 3 < 2""")
def adapted_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions whose title names the local volume, collections with a number of their own, and editions of another volume, which are refused."""
    m, none = F.col("p_partkey") % 3, F.lit(None).cast("string")
    person = lambda name, role: F.struct(F.lit(name).alias("name"), F.lit(role).alias("role"))
    number = lambda c: sequence_struct(c)
    local = F.struct(F.lit("comic").alias("kind"), F.lit(candidates.COLLECTED).alias("subtype"), F.when(m != 1, F.col("p_name")).alias("series_title"), number(F.lit("2")).alias("sequence"))
    found = F.struct(
        F.when(m == 1, "comic_collection").otherwise("book_edition").alias("record_type"), F.when(m == 1, "comic").otherwise("book").alias("media_kind"), F.concat("p_name", F.when(m == 0, " Book Two").when(m == 2, " Book Three").otherwise("")).alias("title"), none.alias("subtitle"), F.array(person("Ann Lee", "author"), person("Big Press", "author"), person("Cy", "editor")).alias("creators"),
        F.lit("Theirs").alias("series_title"), number(F.when(m == 1, "2")).alias("sequence"), F.lit(1990).alias("run_start_year"), F.lit("r").alias("run_id"), F.when(m == 1, "omnibus").alias("item_type"), F.create_map(F.lit("raw"), F.lit("1")).alias("provider_metadata"),
    )
    rows = candidates.adapt_collections(b.table(spark, sf_dir, "part").select(F.concat(F.lit("c"), "p_partkey").alias("candidate_key"), local.alias("l"), found.alias("c")))
    names = F.array_join(F.transform("c.creators", lambda x: F.concat_ws(":", x["name"], x["role"])), "|")
    metadata = F.array_join(F.transform(F.map_entries("c.provider_metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return rows.select("candidate_key", "c.record_type", names.alias("creators"), "c.series_title", F.col("c.sequence.normalized").alias("sequence"), "c.item_type", metadata.alias("metadata"))


# ---- destinations and ownership


@query("""WITH g AS (SELECT p_partkey AS k, upper(left(p_name, 1)) || substr(p_name, 2) AS s, p_size AS n, p_partkey % 3 AS m, p_brand FROM part), h AS (SELECT *, s || CASE WHEN m = 0 THEN ' (' || (2000 + n) || ')' ELSE '' END AS series FROM g)
SELECT k AS p_partkey, CASE m WHEN 0 THEN series || '/' || series || ' - ' || lpad(CAST(n AS VARCHAR), 3, '0') || ' - T_' || k || '.pdf' WHEN 1 THEN s || '/Specials/' || s || ' - v' || lpad(CAST(n AS VARCHAR), 2, '0') || ' - T_' || k || '.pdf' END AS destination,
 'series=' || series || '|title=T:' || k || '|authors=' || p_brand || CASE WHEN k % 2 = 0 THEN '|date=2020-05-06' ELSE '' END || '|identifiers={"isbn":"' || k || '"}' AS metadata, 'series_index' AS preserve, CASE m WHEN 2 THEN 'comic run start year is unresolved' END AS error FROM h""")
def comic_pdf_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("p_partkey"), F.lit(None)
    m = k % 3
    rows = b.table(spark, sf_dir, "part").select(
        "p_partkey", F.lit("comic").alias("media_kind"), F.concat(F.lit("T:"), k).alias("title"), F.array(F.col("p_brand")).alias("creators"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)")).alias("series_title"), sequence_struct(F.col("p_size").cast("string")).alias("sequence"),
        F.when(m == 0, F.col("p_size") + 2000).cast("int").alias("run_start_year"), F.when(m == 1, "omnibus").otherwise("issue").alias("item_type"), F.when(m == 1, F.col("p_size")).alias("collection_volume"), none.cast("string").alias("publisher"), F.lit("2020-05-06").alias("release_date"), F.when(k % 2 == 0, "day").otherwise("month").alias("release_date_precision"),
        none.cast("string").alias("language"), F.create_map(F.lit("isbn"), k.cast("string")).alias("identifiers"), F.create_map().cast("map<string, array<string>>").alias("contributors"),
    )
    got = project.project_comic_pdfs(rows, ["p_partkey"])
    told = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return got.select("p_partkey", "destination", told.alias("metadata"), _joined("ownership.preserve").alias("preserve"), "error")


@query("""SELECT p_partkey, p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND NOT (p_partkey % 2 = 0 AND p_partkey % 7 = 0) AS whole FROM part""")
def ownership_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are set, cleared, preserved and unresolved, some of them in two of the four."""
    k = F.col("p_partkey")
    listed = lambda *x: F.array_compact(F.array(*x))
    own = F.struct(F.create_map(F.lit("title"), F.lit("x")).alias("set"), listed(F.lit("Number"), F.when((k % 2 == 0) & (k % 7 == 0), "Number")).alias("clear"), listed(F.lit("Notes"), F.when(k % 3 == 0, "title")).alias("preserve"), listed(F.when(k % 5 == 0, "Notes")).alias("unresolved"))
    rows = b.table(spark, sf_dir, "part").select("p_partkey", own.alias("own"))
    return rows.select("p_partkey", project.check_ownership(F.col("own")).alias("whole"))


@query("""SELECT p_partkey, [true, false, false, true][p_partkey % 4 + 1] AS language, [true, false, false][p_partkey % 3 + 1] AS date, [true, true, false, false, true][p_partkey % 5 + 1] AS number, [true, false][p_partkey % 2 + 1] AS isbn FROM part""")
def readback_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    rows = b.table(spark, sf_dir, "part").select(
        "p_partkey", F.lit("en_US").alias("l"), _pick(k % 4, "EN", "fr", none, "en-gb").alias("l2"), F.lit("2020-05").alias("d"), _pick(k % 3, "2020-05-17", "2020-06-01", none).alias("d2"), _pick(k % 5, "7", "7", "7", "7", "x").alias("n"), _pick(k % 5, "7.0", "07", "8", "x", "x").alias("n2"), F.lit("978-0-1x").alias("i"), _pick(k % 2, "97801X", "97802X").alias("i2"),
    )
    pairs = {"language": (text.same_language, "l"), "date": (text.same_date, "d"), "number": (text.same_number, "n"), "isbn": (text.same_isbn, "i")}
    return rows.select("p_partkey", *(same(F.col(c), F.col(f"{c}2")).alias(name) for name, (same, c) in pairs.items()))


# ---- plans that may run, and what was accepted at a risk


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans of one item each, altered by their number, validated."""
    k = F.col("o_orderkey")
    item = F.concat(
        F.lit('{"item_id":"'), k, F.lit('","source":{"path":"/a/b/'), k, F.lit('.cbz","signature":"zip"},"projection":{"destination":"d/'), k, F.lit('.cbz"},"provenance":{"explicit_approval":true,"acceptance":{"low_confidence_override":'), F.when(k % 3 == 0, "true").otherwise("false"), F.lit(',"score":'), (k % 100).cast("string"), F.lit('.5,"runner_up_margin":3.0,"material_conflicts":['),
        F.when(k % 4 == 0, '"years differ"').otherwise(""), F.lit(']}},"planning_policy":{"version":"2"},"conflicts":['), F.when(k % 8 == 6, '"x"').otherwise(""), F.lit("]}"),
    )
    doc = F.concat(F.lit('{"schema_version":'), F.when(k % 8 == 2, "2").otherwise("3"), F.lit(',"planning_policy":{"version":"2"},"permissions":{"file_mode":"0644","directory_mode":"0755"},"items":['), F.when(k % 8 == 7, "").otherwise(item), F.lit("]}"))
    rows = b.table(spark, sf_dir, "orders").select(k.alias("id"), doc.alias("canonical_json")).withColumn("sha256", F.sha2("canonical_json", 256))
    rows = rows.withColumn("status", F.when(F.col("id") % 8 == 1, "draft").otherwise("approved")).withColumn("approval_digest", F.when(F.col("id") % 11 > 0, F.col("sha256")))
    return plan.validate_plans(rows)


@query("""SELECT o_orderkey AS id, concat_ws('|', CASE WHEN o_orderkey % 8 = 1 OR o_orderkey % 11 = 0 THEN 'not approved for its exact digest' END, CASE o_orderkey % 8 WHEN 2 THEN 'schema is not current' END, CASE WHEN o_orderkey % 8 = 3 THEN 'invalidated' END, CASE WHEN o_orderkey % 8 = 4 OR o_orderkey % 10 = 0 THEN 'superseded' END, CASE WHEN o_orderkey % 8 = 5 THEN 'stale precondition' END,
 CASE WHEN o_orderkey % 8 = 6 THEN 'item conflicts' END, CASE WHEN o_orderkey % 8 = 7 THEN 'no items' END) AS refusals FROM orders""")
def plan_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, k = _plans(spark, sf_dir), F.col("id")
    flags = [plans.where(when).select(k.alias(name)) for when, name in ((k % 8 == 3, "plan_id"), ((k % 8 == 4) | (k % 10 == 0), "old_plan_id"), (k % 8 == 5, "plan_id"))]
    return plan.eligible_plans(plans, *flags).select("id", _joined("refusals").alias("refusals"))


@query("""SELECT o_orderkey AS plan_id, o_orderkey || '.cbz' AS source, o_orderkey % 100 + 0.5::DOUBLE AS score, 3.0::DOUBLE AS runner_up_margin, CASE WHEN o_orderkey % 4 = 0 THEN 'years differ' ELSE '' END AS conflicts, 'd/' || o_orderkey || '.cbz' AS destination FROM orders WHERE o_orderkey % 8 <> 7 AND (o_orderkey % 3 = 0 OR o_orderkey % 4 = 0)""")
def accepted_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.acceptance_risks(_plans(spark, sf_dir)).select("plan_id", "source", "score", "runner_up_margin", _joined("material_conflicts").alias("conflicts"), "destination")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 5 > 0 THEN p_name END NULLS LAST, CASE WHEN p_size % 3 > 0 THEN p_size END NULLS LAST, 'd/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS place FROM part""")
def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items of a plan; some have no series, some no number."""
    items = b.table(spark, sf_dir, "part").repartition("p_partkey").select("p_partkey", F.when(F.col("p_size") % 5 > 0, F.initcap("p_name")).alias("series_title"), sequence_struct(F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string"))).alias("sequence"), F.concat(F.lit("d/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("destination_path"))
    return rank.display_order(items).select("p_partkey", "place")
