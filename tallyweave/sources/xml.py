"""Metadata documents in XML, one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import text as t

#: Fields of a comic's metadata document that are read and written.
COMIC_FIELDS = ("Title", "Series", "Number", "Volume", "Format", "Year", "Month", "Day", "Writer", "Penciller", "Inker", "Colorist", "Letterer", "CoverArtist", "Editor", "Translator", "Publisher", "Imprint", "LanguageISO", "GTIN")
ROOT = "ComicInfo"


def comicinfo_fields(df: DataFrame, column: str = "xml") -> DataFrame:
    """``df`` with a column per field (trimmed; null if absent or empty) and ``xml_error``: malformed, wrong root or a field twice.

    A document is parsed once, each field into an array, whose length says whether the field repeats. A null document is malformed.
    """
    schema = ", ".join(f"{f} array<string>" for f in COMIC_FIELDS) + ", _bad string"
    parsed = F.from_xml(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    root = t.extract(F.regexp_replace(F.col(column), r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", ""), r"^\s*<([A-Za-z_][\w.-]*)")
    rows = df.withColumn("_x", parsed).withColumn("_root", root)
    twice = F.array_compact(F.array(*(F.when(F.size(f"_x.{f}") > 1, F.lit(f)) for f in COMIC_FIELDS)))
    malformed = F.col("_x").isNull() | F.col("_x._bad").isNotNull() | F.col("_root").isNull()
    rows = rows.withColumn("xml_error", F.when(malformed, "malformed XML").when(F.col("_root") != ROOT, "wrong root element").when(F.size(twice) > 0, F.concat(F.lit("duplicate field: "), F.array_join(twice, ", "))))
    return rows.select(*df.columns, *(F.when(F.col("xml_error").isNull(), t.filled(F.trim(F.get(f"_x.{f}", F.lit(0))))).alias(f) for f in COMIC_FIELDS), "xml_error")


_TEXT = "array<struct<_VALUE: string, _id: string, _role: string>>"
_META = "array<struct<_VALUE: string, _id: string, _name: string, _content: string, _property: string, _refines: string>>"
PACKAGE = f"metadata struct<title: array<struct<_VALUE: string, _id: string>>, publisher: array<struct<_VALUE: string, _id: string>>, date: array<struct<_VALUE: string, _id: string>>, language: array<struct<_VALUE: string, _id: string>>, description: array<struct<_VALUE: string, _id: string>>, creator: {_TEXT}, contributor: {_TEXT}, subject: array<struct<_VALUE: string, _id: string>>, identifier: array<struct<_VALUE: string, _id: string>>, meta: {_META}>, _bad string"


def opf_fields(df: DataFrame, column: str = "xml") -> DataFrame:
    """``df`` with title, publisher, date, language, description, creators, contributors (role to names), subjects, identifiers, series, series_index and ``xml_error``.

    A role is that of the element, else one that refines it, else author. A series comes from a collection, else from the named meta;
    its place is one that refines the collection, else the named one.
    """
    p = F.from_xml(F.col(column), PACKAGE, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "valueTag": "_VALUE", "attributePrefix": "_"})
    rows = df.withColumn("_p", p).withColumn("_bad", F.col(column).isNull() | F.col("_p").isNull() | F.col("_p._bad").isNotNull() | F.col("_p.metadata").isNull())
    m = lambda c: F.col(f"_p.metadata.{c}")
    first = lambda c: t.filled(F.trim(F.get(F.filter(m(c), lambda x: x["_VALUE"].isNotNull()), F.lit(0))["_VALUE"]))
    all_ = lambda c: F.coalesce(F.transform(F.filter(m(c), lambda x: F.coalesce(F.trim(x["_VALUE"]), F.lit("")) != ""), lambda x: F.trim(x["_VALUE"])), t.no_texts())
    metas = F.coalesce(m("meta"), F.array().cast(_META))
    refined = lambda ref, prop: F.get(F.filter(metas, lambda x: (x["_property"] == prop) & (x["_refines"] == F.concat(F.lit("#"), ref))), F.lit(0))["_VALUE"]
    people = F.concat(F.coalesce(m("creator"), F.array().cast(_TEXT)), F.coalesce(m("contributor"), F.array().cast(_TEXT)))
    named = F.transform(F.filter(people, lambda x: F.coalesce(F.trim(x["_VALUE"]), F.lit("")) != ""), lambda x: F.struct(F.coalesce(t.filled(x["_role"]), t.filled(refined(x["_id"], "role")), F.lit("aut")).alias("role"), F.trim(x["_VALUE"]).alias("name")))
    roles = F.array_distinct(F.transform(named, lambda x: x["role"]))
    groups = F.map_from_entries(F.transform(roles, lambda r: F.struct(r.alias("key"), F.transform(F.filter(named, lambda x: x["role"] == r), lambda x: x["name"]).alias("value"))))
    by_name = lambda n: F.get(F.filter(metas, lambda x: x["_name"] == n), F.lit(0))["_content"]
    collection = F.get(F.filter(metas, lambda x: x["_property"] == "belongs-to-collection"), F.lit(0))
    series = t.first_filled(F.trim(collection["_VALUE"]), F.trim(by_name("calibre:series")))
    index = t.first_filled(F.trim(refined(collection["_id"], "group-position")), F.trim(by_name("calibre:series_index")))
    ok = lambda c: F.when(~F.col("_bad"), c)
    return rows.select(
        *df.columns, *(ok(first(c)).alias(c) for c in ("title", "publisher", "date", "language", "description")), ok(F.coalesce(F.try_element_at(groups, F.lit("aut")), t.no_texts())).alias("creators"), ok(groups).alias("contributors"), ok(all_("subject")).alias("subjects"), ok(all_("identifier")).alias("identifiers"),
        ok(series).alias("series"), ok(index).alias("series_index"), F.when(F.col("_bad"), "malformed package document").alias("xml_error"),
    )


def text_of(value: Column) -> Column:
    """A text escaped for an XML element."""
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
