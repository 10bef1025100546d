"""Catalogue feeds in JSON to one candidate schema; malformed payloads to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import text as t
from tallyweave.functions.sequence import sequence_struct
from tallyweave.operators.golden import _map
from tallyweave.schemas import CREDITS, IDENTIFIERS

ITEM_TYPES = {"annual": "annual", "one shot": "one-shot", "oneshot": "one-shot", "special": "special", "tpb": "collected-edition", "trade paperback": "collected-edition", "hardcover": "collected-edition", "omnibus": "omnibus", "graphic novel": "graphic-novel"}
COLLECTIONS = ("collected-edition", "omnibus", "graphic-novel")
CREDIT_ROLES = {"writer": "writer", "script": "writer", "penciler": "penciller", "penciller": "penciller", "inker": "inker", "colorist": "colorist", "colourist": "colorist", "letterer": "letterer", "cover": "cover-artist", "cover artist": "cover-artist", "editor": "editor", "translator": "translator", "artist": "artist"}

_HOUSE = "struct<name: string>"
_ISSUE = f"struct<id: string, resource_type: string, api_detail_url: string, name: string, issue_number: string, cover_date: string, store_date: string, start_year: string, format: string, volume: struct<id: string, api_detail_url: string, name: string, start_year: string, publisher: {_HOUSE}>, publisher: {_HOUSE}, person_credits: array<struct<name: string, role: string>>>"
_VOLUME = "struct<id: string, volumeInfo: struct<title: string, subtitle: string, authors: array<string>, publisher: string, publishedDate: string, language: string, industryIdentifiers: array<struct<type: string, identifier: string>>>>"
_EDITION = "struct<key: string, title: string, subtitle: string, isbn: array<string>, publisher: array<string>, publish_date: array<string>, language: array<string>>"
_WORK = f"struct<key: string, title: string, subtitle: string, author_name: array<string>, first_publish_date: string, first_publish_year: string, isbn: array<string>, publisher: array<string>, language: array<string>, editions: struct<docs: array<{_EDITION}>>>"
_SINGLE = "key string, title string, subtitle string, first_publish_date string, publishers array<string>, publish_date string, isbn_10 array<string>, isbn_13 array<string>, languages array<struct<key: string>>, works array<struct<key: string>>"


def _parsed(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_j``, rows that are not JSON of that shape with ``error``)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = df.withColumn("_j", F.from_json(column, f"{schema}, _bad string", options))
    bad = F.col("_j").isNull() | F.col("_j._bad").isNotNull()
    return rows.where(~bad), rows.where(bad).drop("_j").withColumn("error", F.lit("malformed payload"))


def _candidate(provider: str | Column, fields: dict[str, Column]) -> list[Column]:
    """The candidate columns; what ``fields`` lacks is null."""
    text = ("provider_id", "record_type", "media_kind", "title", "subtitle", "publisher", "publication_date", "release_date", "release_date_precision", "cover_date", "cover_date_precision", "language", "series_title", "item_type", "work_id", "edition_id", "run_id")
    kinds = {c: "string" for c in text} | {"run_start_year": "int", "creators": CREDITS, "identifiers": IDENTIFIERS, "provider_metadata": "map<string,string>", "provider_schema_version": "int"}
    order = ("provider_id", "record_type", "media_kind", "title", "subtitle", "creators", "identifiers", "publisher", "publication_date", "release_date", "release_date_precision", "cover_date", "cover_date_precision", "language", "series_title", "run_start_year", "sequence", "item_type", "work_id", "edition_id", "run_id", "provider_metadata", "provider_schema_version")
    lead = provider if isinstance(provider, Column) else F.lit(provider)
    empty = {"creators": F.array(), "identifiers": F.array(), "provider_metadata": F.create_map()}
    made = {c: fields.get(c, empty.get(c, F.lit(None))).cast(kinds[c]) if c in kinds else fields.get(c, sequence_struct(F.lit(None).cast("string"))) for c in order}
    key = F.concat_ws(":", lead, made["provider_id"], made["record_type"]).alias("candidate_key")
    return [key, lead.alias("provider"), *(made[c].alias(c) for c in order)]


def _isbns(values: Column) -> Column:
    return F.transform(F.filter(F.coalesce(values, t.no_texts()), lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.struct(F.lit("isbn").alias("scheme"), x.alias("value")))


def _authors(values: Column) -> Column:
    return F.transform(F.filter(F.coalesce(values, t.no_texts()), lambda x: x.isNotNull()), lambda x: F.struct(x.alias("name"), F.lit("author").alias("role")))


def cover_month(date: Column) -> tuple[Column, Column]:
    """(date, precision) of a cover date: the year, or the month if the whole date exists."""
    year = F.when(date.rlike(r"^\d{4}$") & (date != "0000"), date)
    day = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_date(date, "yyyy-MM-dd"), "yyyy-MM"))
    month = F.when(date.rlike(r"^(?!0000)\d{4}-(?:0[1-9]|1[0-2])$"), date)
    return F.coalesce(year, day, month), F.when(year.isNotNull(), "year").when(day.isNotNull() | month.isNotNull(), "month")


def normalize_comic_feed(df: DataFrame, column: str = "payload", provider: str = "comic", version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(candidates, quarantined payloads) of a comic feed; ``results`` is a list or a single object."""
    known = F.get_json_object(column, "$.results").isNotNull()
    single = F.from_json(F.get_json_object(column, "$.results"), _ISSUE)
    many = F.from_json(F.get_json_object(column, "$.results"), f"array<{_ISSUE}>")
    good = df.where(known)
    is_list = F.startswith(F.ltrim(F.get_json_object(column, "$.results")), F.lit("["))
    rows = good.select(F.explode(F.when(is_list, many).otherwise(F.array(single))).alias("i")).where("i.id is not null")
    url = F.coalesce("i.api_detail_url", F.lit(""))
    issue = F.coalesce(F.col("i.resource_type") == "issue", F.lit(False)) | url.contains("/issue/")
    api = r"/(?:issue|volume)/(\d+-\d+)/"
    series = t.first_filled(F.trim("i.volume.name"), F.trim("i.name"))
    label = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    shape = t.filled(F.trim("i.format"))
    item = F.when(shape.isNull(), F.when(issue, "issue").otherwise("run")).otherwise(F.coalesce(_map(label(shape), ITEM_TYPES), F.lit("unsupported")))
    pid = F.coalesce(t.extract(url, api), F.concat(F.when(issue, "4000-").otherwise("4050-"), "i.id"))
    run = F.when(issue, F.coalesce(t.extract(F.col("i.volume.api_detail_url"), api), F.concat(F.lit("4050-"), "i.volume.id"))).otherwise(pid)
    year = lambda c: t.extract(c, r"^(\d{4})").cast("int")
    store = F.trim("i.store_date")
    release = F.when(issue & store.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_date(store, "yyyy-MM-dd"), "yyyy-MM-dd"))
    cover, precision = cover_month(F.when(issue, F.trim("i.cover_date")))
    number = t.filled(F.trim("i.issue_number"))

    def roles(x: Column) -> Column:
        tokens = F.split(F.coalesce(t.filled(F.trim(x["role"])), F.lit("creator")), ",")
        return F.transform(tokens, lambda r: F.struct(F.trim(x["name"]).alias("name"), F.coalesce(_map(label(r), CREDIT_ROLES), F.concat(F.lit("unknown:"), F.coalesce(t.filled(label(r)), F.lit("creator")))).alias("role")))

    people = F.filter(F.coalesce("i.person_credits", F.array().cast(CREDITS)), lambda x: F.coalesce(F.trim(x["name"]), F.lit("")) != "")
    told = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("raw_format", shape), ("release_date_source", F.when(release.isNotNull(), "store_date")), ("cover_date_source", F.when(cover.isNotNull(), "cover_date")), ("cover_date_precision", precision)))), lambda e: e["value"].isNotNull())
    fields = {
        "provider_id": pid, "record_type": F.when(item.isin(*COLLECTIONS), "comic_collection").when(issue, "comic_issue").otherwise("comic_run"), "media_kind": F.lit("comic"), "title": F.coalesce(t.filled(F.trim("i.name")), series),
        "creators": F.array_distinct(F.flatten(F.transform(people, roles))), "identifiers": F.array(F.struct(F.lit(provider).alias("scheme"), pid.alias("value"))), "publisher": t.first_filled(F.col("i.publisher.name"), F.col("i.volume.publisher.name")),
        "release_date": release, "release_date_precision": F.when(release.isNotNull(), "day"), "cover_date": cover, "cover_date_precision": precision, "series_title": series, "run_start_year": F.coalesce(year(F.col("i.start_year")), year(F.col("i.volume.start_year"))),
        "sequence": sequence_struct(number), "item_type": item, "run_id": run, "provider_metadata": F.map_from_entries(told), "provider_schema_version": F.lit(version),
    }
    return rows.where(series.isNotNull()).select(*_candidate(provider, fields)), df.where(~known).withColumn("error", F.lit("payload without results"))


def normalize_volume_feed(df: DataFrame, column: str = "payload", provider: str = "volume", version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(candidates, quarantine) of a book-volume feed: all are editions; entries without id or title are left out."""
    good, bad = _parsed(df, column, f"items array<{_VOLUME}>")
    rows = good.select(F.explode("_j.items").alias("i")).where("i.id is not null and i.volumeInfo.title is not null")
    info = lambda c: F.col(f"i.volumeInfo.{c}")
    some = F.filter(F.coalesce(info("industryIdentifiers"), F.array().cast("array<struct<type: string, identifier: string>>")), lambda x: (F.coalesce(x["type"], F.lit("")) != "") & (F.coalesce(x["identifier"], F.lit("")) != ""))
    fields = {
        "provider_id": F.col("i.id"), "record_type": F.lit("book_edition"), "media_kind": F.lit("book"), "title": info("title"), "subtitle": t.filled(info("subtitle")), "creators": _authors(info("authors")), "publisher": t.filled(info("publisher")),
        "identifiers": F.transform(some, lambda x: F.struct(F.lower(x["type"]).alias("scheme"), x["identifier"].alias("value"))), "publication_date": t.filled(info("publishedDate")), "language": t.filled(info("language")), "edition_id": F.col("i.id"), "provider_schema_version": F.lit(version),
    }
    return rows.select(*_candidate(provider, fields)), bad


def _first(values: Column) -> Column:
    return t.filled(F.get(values, F.lit(0)))


def normalize_work_feed(df: DataFrame, column: str = "payload", provider: str = "work", editions: bool = False, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(candidates, quarantine) of a search of works; with ``editions``, the editions nested in them, which inherit the work's authors."""
    good, bad = _parsed(df, column, f"docs array<{_WORK}>")
    missing = good.where("_j.docs is null").drop("_j").withColumn("error", F.lit("payload without docs"))
    works = good.select(F.explode("_j.docs").alias("w"))
    work_id = t.filled(F.btrim(F.coalesce("w.key", F.lit("")), F.lit("/")))
    if editions:
        rows = works.select("w", F.explode("w.editions.docs").alias("e")).where("e.title is not null")
        key = F.substring_index(F.btrim(F.coalesce("e.key", F.lit("")), F.lit("/")), "/", -1)
        fields = {
            "provider_id": key, "record_type": F.lit("book_edition"), "media_kind": F.lit("book"), "title": F.col("e.title"), "subtitle": t.filled(F.col("e.subtitle")), "creators": _authors(F.col("w.author_name")), "identifiers": _isbns(F.col("e.isbn")), "publisher": _first(F.col("e.publisher")),
            "publication_date": _first(F.col("e.publish_date")), "language": _first(F.col("e.language")), "work_id": work_id, "edition_id": key, "provider_schema_version": F.lit(version),
        }
        return rows.where(key.endswith("M")).select(*_candidate(provider, fields)), bad.unionByName(missing)
    fields = {
        "provider_id": work_id, "record_type": F.lit("book_work"), "media_kind": F.lit("book"), "title": F.col("w.title"), "subtitle": t.filled(F.col("w.subtitle")), "creators": _authors(F.col("w.author_name")), "identifiers": _isbns(F.col("w.isbn")), "publisher": _first(F.col("w.publisher")),
        "publication_date": t.first_filled(F.col("w.first_publish_date"), F.col("w.first_publish_year")), "language": _first(F.col("w.language")), "work_id": work_id, "provider_schema_version": F.lit(version),
    }
    return works.where(work_id.isNotNull() & F.col("w.title").isNotNull()).select(*_candidate(provider, fields)), bad.unionByName(missing)


def normalize_edition_feed(df: DataFrame, column: str = "payload", provider: str = "work", version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(candidates, quarantine) of single work and edition documents; an edition's key ends in M."""
    good, bad = _parsed(df, column, _SINGLE)
    key = F.btrim(F.coalesce("_j.key", F.lit("")), F.lit("/"))
    lacking = (key == "") | F.col("_j.title").isNull()
    rows = good.where(~lacking)
    edition = key.endswith("M")
    short = F.substring_index(key, "/", -1)
    work = t.filled(F.btrim(F.coalesce(F.get("_j.works", F.lit(0))["key"], F.lit("")), F.lit("/")))
    only = lambda c: F.when(edition, c)
    fields = {
        "provider_id": F.when(edition, short).otherwise(key), "record_type": F.when(edition, "book_edition").otherwise("book_work"), "media_kind": F.lit("book"), "title": F.col("_j.title"), "subtitle": only(t.filled(F.col("_j.subtitle"))),
        "identifiers": F.when(edition, F.concat(_isbns(F.col("_j.isbn_10")), _isbns(F.col("_j.isbn_13")))).otherwise(F.array().cast(IDENTIFIERS)), "publisher": only(_first(F.col("_j.publishers"))), "publication_date": F.when(edition, t.filled(F.col("_j.publish_date"))).otherwise(t.extract(F.col("_j.first_publish_date"), r"(\d{4})")),
        "language": only(t.filled(F.substring_index(F.get("_j.languages", F.lit(0))["key"], "/", -1))), "work_id": F.when(edition, work).otherwise(key), "edition_id": only(short), "provider_schema_version": F.lit(version),
    }
    return rows.select(*_candidate(provider, fields)), bad.unionByName(good.where(lacking).drop("_j").withColumn("error", F.lit("document without key or title")))


def renormalize(cache: DataFrame, version: int, now: float, offline: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reuse, redo, miss): cached rows of this version, rows to normalise again from their raw payload, and expired ones.

    Expired rows count only offline. ``cache`` has schema_version, candidate_version and expires_at.
    """
    live = F.lit(True) if offline else F.col("expires_at") > now
    current = (F.col("schema_version") == version) & F.coalesce(F.col("candidate_version") == version, F.lit(False))
    return cache.where(live & current), cache.where(live & ~current), cache.where(~live)
