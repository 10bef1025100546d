"""Registered queries of names: every shape of comic and book names, every class, tokens and evidence as whole rows, local identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import names
from tallyweave.operators import candidates
from tallyweave.plans import bindings as b
from tallyweave.plans.queries import query

_N = "upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2)"
_PARTS = f"WITH p AS (SELECT p_partkey AS k, p_type, {_N} AS n FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.spread(b.table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("k"), F.initcap("p_name").alias("n"), "p_type")


def _shape(of: int, *shapes: str) -> Column:
    """The shape of a part's number; ``{}`` stands for its name."""
    said = F.element_at(F.array(*map(F.lit, shapes)), (F.col("k") % of + 1).cast("int"))
    return F.replace(said, F.lit("{}"), F.col("n"))


# ---- comic names: a shape for each of the thirteen rules


@query(f"""{_PARTS} SELECT k, CASE WHEN k % 13 IN (0, 1, 2, 3, 4, 11) THEN 'collected-edition' WHEN k % 13 IN (5, 6, 7, 10) THEN 'issue' WHEN k % 13 = 8 THEN 'annual' WHEN k % 13 = 9 THEN 'special' ELSE 'one-shot' END AS subtype,
 CASE k % 13 WHEN 8 THEN n || ' Annual' WHEN 9 THEN n || ' Special' WHEN 10 THEN 'Saga' ELSE n END AS series,
 CASE k % 13 WHEN 0 THEN 'Ultimate Collection Book 02' WHEN 1 THEN 'Volume 3' WHEN 2 THEN n || ' Omnibus' WHEN 3 THEN 'Volume 7' WHEN 4 THEN 'The Complete Tale in One Volume' WHEN 5 THEN 'Dark Night' WHEN 11 THEN 'deluxe edition' WHEN 12 THEN n END AS title,
 CASE k % 13 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 3 THEN '7' WHEN 5 THEN '4' WHEN 6 THEN '12' WHEN 7 THEN '5A' WHEN 10 THEN '9' END AS sequence, CASE WHEN k % 13 = 6 THEN CAST(1999 AS INTEGER) END AS year,
 CASE k % 13 WHEN 0 THEN 'Ann Lee' ELSE '' END AS creators, CASE k % 13 WHEN 0 THEN 'Ultimate Collection' WHEN 2 THEN 'Omnibus' WHEN 4 THEN 'The Complete Tale in One Volume' WHEN 11 THEN 'deluxe edition' ELSE '' END AS qualifiers FROM p""")
def comic_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = _shape(13, "{} by Ann Lee Ultimate Collection Book 02", "{} Volume 03", "{} Omnibus", "{} v07", "{} - The Complete Tale in One Volume", "{} - V2 - 004 - Dark Night", "{} #012 (1999)", "{} 5A", "{} Annual", "{} Special", "{}", "{} (deluxe edition)", "{}")
    embedded = F.col("k") % 13 == 10
    rows = _parts(spark, sf_dir).select("k", F.concat(F.lit("in/"), shape, F.lit(".cbz")).alias("path"), F.when(embedded, "Saga").alias("series"), F.when(embedded, "9").alias("number"))
    c = names.parse_comic_names(rows, series="series", number="number")
    return c.select("k", "comic.subtype", "comic.series", "comic.title", F.col("comic.sequence.normalized").alias("sequence"), "comic.year", F.array_join("comic.creators", "|").alias("creators"), F.array_join("comic.edition_qualifiers", "|").alias("qualifiers"))


# ---- book names


@query(f"""{_PARTS} SELECT k, CASE WHEN k % 4 = 3 THEN 'series-book' ELSE 'standalone-book' END AS subtype, CASE k % 4 WHEN 2 THEN n || ' Handbook' WHEN 3 THEN 'Tale' ELSE n END AS title, CASE WHEN k % 4 = 3 THEN 'Saga' END AS series, CASE WHEN k % 4 = 3 THEN '3' END AS sequence,
 CASE k % 4 WHEN 0 THEN CAST(1999 AS INTEGER) WHEN 3 THEN 2004 END AS year, CASE k % 4 WHEN 1 THEN 'Ann Lee' WHEN 2 THEN 'Bo Ray' ELSE '' END AS creators, CASE WHEN k % 4 = 2 THEN 'book-like filename evidence' ELSE 'EPUB container' END AS reason FROM p""")
def book_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = F.col("k") % 4 == 3
    rows = _parts(spark, sf_dir).select("k", _shape(4, "in/{} (1999).epub", "in/{} by Ann Lee.epub", "in/{} Handbook Bo Ray.pdf", "in/{} 2004 www.site.com.epub").alias("path"), *(F.when(embedded, v).alias(c) for c, v in (("t", "Tale"), ("s", "Saga"), ("i", "3"))))
    got = names.parse_book_names(rows, title="t", series="s", series_index="i")
    return got.select("k", "book.subtype", "book.title", "book.series", F.col("book.sequence.normalized").alias("sequence"), "book.year", F.array_join("book.creators", "|").alias("creators"), F.get("book.reasons", F.lit(0)).alias("reason"))


# ---- classes: each branch of the classification


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = _shape(7, "in/{}.epub", "in/{} #3.cbz", "in/{}.cbz", "in/{} #3.pdf", "in/{} Handbook.pdf", "in/{}.pdf", "in/{}.bin")
    format = F.element_at(F.array(*map(F.lit, ("epub", "cbz", "cbr", "pdf", "pdf", "pdf", "unknown"))), (F.col("k") % 7 + 1).cast("int"))
    rows = _parts(spark, sf_dir).select("k", shape.alias("path"), format.alias("format"), F.when(F.col("k") % 7 == 2, F.when(F.col("k") % 2 == 0, 150).otherwise(30)).alias("pages"))
    return names.classify(names.parse_book_names(names.parse_comic_names(rows)), page_count="pages")


@query(f"""{_PARTS} SELECT k, CASE WHEN k % 7 IN (0, 4, 5) THEN 'book' WHEN k % 7 = 6 THEN 'unknown' ELSE 'comic' END AS kind,
 CASE WHEN k % 7 IN (0, 4, 5) THEN 'standalone-book' WHEN k % 7 IN (1, 3) THEN 'issue' WHEN k % 7 = 6 THEN 'unknown' WHEN k % 2 = 0 THEN 'collected-edition' ELSE 'one-shot' END AS subtype,
 CAST(CASE k % 7 WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 0.78 ELSE 0.98 END WHEN 3 THEN 0.92 WHEN 4 THEN 0.92 WHEN 5 THEN 0.52 WHEN 6 THEN 0.0 ELSE 0.98 END AS DOUBLE) AS confidence, k % 7 IN (5, 6) OR (k % 7 = 2 AND k % 2 = 0) AS ambiguous,
 CASE WHEN k % 7 IN (3, 4, 5) OR (k % 7 = 2 AND k % 2 = 0) THEN 2 ELSE 1 END AS hypotheses FROM p""")
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("classification")
    return _classified(spark, sf_dir).select("k", c["kind"].alias("kind"), c["subtype"].alias("subtype"), c["confidence"].alias("confidence"), c["ambiguous"].alias("ambiguous"), F.size(c["hypotheses"]).alias("hypotheses"))


# ---- evidence and tokens as whole rows


@query(f"""{_PARTS}, e AS (SELECT k, unnest([
 {{'field': 'filename', 'raw': n || ' #' || k || ' (2013, deluxe edition) (c2c) www.site.com.cbz', 'normalized': n || ' #' || k || ' (2013, deluxe edition) (c2c) www.site.com', 'source': 'filename', 'confidence': 1.0, 'is_noise': false}},
 {{'field': 'folder', 'raw': 'Box ' || k % 3, 'normalized': 'Box ' || k % 3, 'source': 'parent-folder', 'confidence': 0.75, 'is_noise': false}}, {{'field': 'publisher', 'raw': p_type, 'normalized': lower(p_type), 'source': 'embedded', 'confidence': 0.95, 'is_noise': false}},
 {{'field': 'year', 'raw': '2013', 'normalized': '2013', 'source': 'filename-token', 'confidence': 0.8, 'is_noise': false}}, {{'field': 'edition-qualifier', 'raw': 'deluxe edition', 'normalized': 'deluxe edition', 'source': 'filename-token', 'confidence': 0.8, 'is_noise': false}},
 {{'field': 'release-noise', 'raw': 'c2c', 'normalized': 'c2c', 'source': 'filename-token', 'confidence': 0.8, 'is_noise': true}}, {{'field': 'sequence', 'raw': CAST(k AS VARCHAR), 'normalized': CAST(k AS VARCHAR), 'source': 'filename-token', 'confidence': 0.8, 'is_noise': false}},
 {{'field': 'text', 'raw': split_part(n, ' ', 1), 'normalized': lower(split_part(n, ' ', 1)), 'source': 'filename-token', 'confidence': 0.8, 'is_noise': false}}, {{'field': 'text', 'raw': split_part(n, ' ', 2), 'normalized': lower(split_part(n, ' ', 2)), 'source': 'filename-token', 'confidence': 0.8, 'is_noise': false}},
 {{'field': 'text', 'raw': '#' || k, 'normalized': '#' || k, 'source': 'filename-token', 'confidence': 0.8, 'is_noise': false}}, {{'field': 'release-noise', 'raw': 'www.site.com', 'normalized': 'www.site.com', 'source': 'filename-token', 'confidence': 0.8, 'is_noise': true}}]) AS x FROM p)
SELECT k, x.field, x.raw, x.normalized, x.source, CAST(x.confidence AS DOUBLE) AS confidence, x.is_noise FROM e""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("in/Box "), F.col("k") % 3, F.lit("/"), "n", F.lit(" #"), "k", F.lit(" (2013, deluxe edition) (c2c) www.site.com.cbz"))
    rows = _parts(spark, sf_dir).select("k", path.alias("path"), "p_type")
    return names.evidence_long(rows, embedded={"publisher": "p_type"}).select("k", "field", "raw", "normalized", "source", "confidence", "is_noise")


# ---- local identities of the classes


@query(f"""{_PARTS} SELECT CAST(k AS VARCHAR) AS source_id, CASE WHEN k % 7 IN (0, 4, 5) THEN 'book' WHEN k % 7 = 6 THEN 'unknown' ELSE 'comic' END AS kind, CASE k % 7 WHEN 0 THEN n WHEN 4 THEN n || ' Handbook' WHEN 5 THEN n WHEN 2 THEN n WHEN 6 THEN n ELSE '' END AS title,
 CASE WHEN k % 7 IN (1, 2, 3) THEN n END AS series_title, CASE WHEN k % 7 IN (1, 3) THEN '3' END AS sequence, CASE WHEN k % 7 IN (1, 2, 3) AND k % 5 > 0 THEN 'Ann|Bo Ray' ELSE '' END AS creators,
 concat_ws('|', 'isbn:978' || lpad(CAST(k AS VARCHAR), 10, '0'), CASE WHEN k % 3 = 0 THEN 'gtin:77' END) AS identifiers, CASE WHEN k % 5 > 0 THEN 'House' END AS publisher FROM p""")
def local_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.col("k") % 5 > 0
    isbn = F.concat(F.lit("978-"), F.lpad(F.col("k").cast("string"), 10, "0"))
    rows = _classified(spark, sf_dir).withColumn("writer", F.when(some, " Ann, Bo Ray ")).withColumn("ids", F.array(isbn, F.lit("12-3"))).withColumn("gtin", F.when(F.col("k") % 3 == 0, "77")).withColumn("house", F.when(some, " House ").otherwise(" ")).withColumn("key", F.col("k").cast("string"))
    got = candidates.local_identity(rows, "key", publisher="house", writer="writer", identifiers="ids", gtin="gtin")
    ids = F.array_join(F.transform("identifiers", lambda x: F.concat_ws(":", x["scheme"], x["value"])), "|")
    return got.select("source_id", "kind", "title", "series_title", F.col("sequence.normalized").alias("sequence"), F.array_join("creators", "|").alias("creators"), ids.alias("identifiers"), "publisher")
