"""Target projection: name templates, metadata to write, destination paths, format routing."""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import text as t
from tallyweave.functions.sequence import render_sequence
from tallyweave.operators.golden import planning_blocks

FIELDS = ("title", "series", "series_or_title", "number", "year", "author", "format")
# Names of formats and credits in written metadata.
FORMATS = {"annual": "Annual", "special": "Special", "one-shot": "One-Shot", "trade": "Trade Paperback", "collected-edition": "Trade Paperback", "omnibus": "Omnibus", "graphic-novel": "Graphic Novel"}
CREDIT_FIELDS = {"writers": "Writer", "pencillers": "Penciller", "inkers": "Inker", "colorists": "Colorist", "letterers": "Letterer", "cover_artists": "CoverArtist", "editors": "Editor", "translators": "Translator"}


@dataclass(frozen=True)
class NamingPolicy:
    book_folder: str = "{series_or_title}"
    book_file: str = "{title}"
    book_series_file: str = "{series} - {number} - {title}"
    comic_folder: str = "{series}"
    comic_file: str = "{series} - {number} - {title}"
    integer_padding: int = 3
    comic_specials_subfolder: bool = True

    def __post_init__(self):
        if not 1 <= self.integer_padding <= 12:
            raise ValueError("integer_padding must be from 1 to 12")
        for template in (self.book_folder, self.book_file, self.book_series_file, self.comic_folder, self.comic_file):
            check_template(template)


def check_template(template: str) -> None:
    """Only known plain fields, no path separators, not blank."""
    if not template.strip():
        raise ValueError("a naming template cannot be empty")
    for literal, name, spec, conversion in Formatter().parse(template):
        if "/" in literal or "\\" in literal:
            raise ValueError("a naming template must render one path component")
        if name is not None and (name not in FIELDS or spec or conversion):
            raise ValueError(f"unsupported field in naming template: {name}")


def sanitise(c: Column) -> Column:
    """A safe path component; null (an error) if nothing is left."""
    clean = F.btrim(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"(?U)\s+", " "), F.lit(" ."))
    return F.when(clean != "", clean)


def render_name(template: str, values: dict[str, Column]) -> Column:
    """The template with its fields, empty groups and separators around missing values removed; null if nothing is left."""
    check_template(template)
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts += [F.lit(literal)] if literal else []
        parts += [F.coalesce(values[name].cast("string"), F.lit(""))] if name is not None else []
    text = F.concat(*parts) if parts else F.lit("")
    for pattern, by in ((r"\(\s*\)|\[\s*\]", ""), (r"(?U)(?:\s+-\s+){2,}", " - "), (r"(?U)(?:\s*[-–—:,;]\s*)+$", ""), (r"(?U)^\s*[-–—:,;]\s*", ""), (r"(?U)\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return sanitise(F.trim(text))


def _entries(*pairs: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs))


def _filled_map(entries: Column) -> Column:
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def _ownership(values: Column, clear: Column, preserve: Column, unresolved: Column | None = None) -> Column:
    return F.struct(values.alias("set"), clear.alias("clear"), preserve.alias("preserve"), (unresolved if unresolved is not None else t.no_texts()).alias("unresolved")).alias("ownership")


def check_ownership(ownership: Column) -> Column:
    """Whether set, clear, preserve and unresolved have no field in common."""
    parts = [F.map_keys(ownership["set"]), ownership["clear"], ownership["preserve"], ownership["unresolved"]]
    every = F.concat(*parts)
    return F.size(F.array_distinct(every)) == F.size(every)


def _comic_names(policy: NamingPolicy) -> dict[str, Column]:
    year, volume = F.col("run_start_year"), F.col("collection_volume")
    series = F.concat(F.col("series_title"), F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")))
    number = F.coalesce(F.concat(F.lit("v"), F.lpad(volume.cast("string"), F.greatest(F.length(volume.cast("string")), F.lit(2)), F.lit("0"))), render_sequence(F.col("sequence"), policy.integer_padding))
    return {"title": t.filled(F.col("title")), "series": series, "series_or_title": series, "number": number, "year": year, "author": F.get("creators", F.lit(0)), "format": comic_format()}


def comic_format() -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), F.coalesce("item_type", F.lit("issue")))


def comic_date_fields(date: Column) -> dict[str, Column]:
    """Year, month and day as far as a date states them and they exist."""
    whole = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date, "yyyy-MM-dd"))
    month = F.when(date.rlike(r"^\d{4}-(?:0[1-9]|1[0-2])$"), date)
    good = whole.isNotNull() | month.isNotNull() | date.rlike(r"^\d{4}$")
    year = F.when(good & (F.substring(date, 1, 4) != "0000"), F.substring(date, 1, 4).cast("int"))
    return {"Year": year, "Month": F.when(year.isNotNull(), F.substring(F.coalesce(F.date_format(whole, "yyyy-MM"), month), 6, 2).cast("int")), "Day": F.when(year.isNotNull(), F.dayofmonth(whole))}


def _placed(rows: DataFrame, keys: list[str], metadata: Column, folder: Column, filename: Column, ownership: Column, kind: str) -> DataFrame:
    blocks = F.when(F.col("media_kind") != kind, F.array(F.lit(f"projection requires a {kind} identity"))).otherwise(planning_blocks())
    named = rows.select(*keys, blocks.alias("blocks"), metadata.alias("metadata"), folder.alias("folder"), filename.alias("filename"), ownership)
    error = F.when(F.size("blocks") > 0, F.array_join("blocks", "; ")).when(F.col("folder").isNull() | F.col("filename").isNull(), "name component is empty after sanitization")
    return named.withColumn("destination", F.when(error.isNull(), F.concat_ws("/", "folder", "filename"))).withColumn("error", error).drop("blocks")


def project_comics(golden: DataFrame, keys: list[str], extension: str = ".cbz", policy: NamingPolicy | None = None) -> DataFrame:
    """(keys, metadata, folder, filename, ownership, destination, error) of comic records.

    Collections with a volume have no number; one-offs without a sequence count as number 1; special formats have a subfolder; dates
    are written only if they are exact to the day.
    """
    policy = policy or NamingPolicy()
    names = _comic_names(policy)
    like = F.col("item_type").isin("trade", "collected-edition", "omnibus")
    number = F.when(like & F.col("collection_volume").isNotNull(), "").otherwise(F.coalesce("sequence.normalized", F.when(like, "").otherwise("1")))
    day = F.when(F.col("release_date_precision") == "day", F.col("release_date"))
    dates = comic_date_fields(day)
    own = {"Number": number, "Volume": F.coalesce(F.col("collection_volume").cast("string"), F.lit("")), "Format": F.coalesce(comic_format(), F.lit(""))}
    credits = [(field, F.array_join(F.try_element_at("contributors", F.lit(group)), ", ")) for group, field in CREDIT_FIELDS.items()]
    values = _entries(("Series", names["series"]), *own.items(), ("Title", F.col("title")), *credits, ("Publisher", F.col("publisher")), *dates.items(), ("LanguageISO", F.col("language")))
    cleared = F.array_compact(F.array(*(F.when(v == "", F.lit(k)) for k, v in own.items())))
    kept = F.concat(F.array(*map(F.lit, ("Notes", "Web", "PageCount", "Pages"))), F.when(dates["Year"].isNull(), F.array(*map(F.lit, ("Year", "Month", "Day")))).otherwise(t.no_texts()))
    folder = render_name(policy.comic_folder, names)
    if policy.comic_specials_subfolder:
        folder = F.when(comic_format().isNotNull(), F.concat(folder, F.lit("/Specials"))).otherwise(folder)
    return _placed(golden, keys, _filled_map(values), folder, F.concat(render_name(policy.comic_file, names), F.lit(_dotted(extension))), _ownership(_filled_map(values), cleared, kept), "comic")


def project_comic_pdfs(golden: DataFrame, keys: list[str], policy: NamingPolicy | None = None) -> DataFrame:
    """Comic records in PDF: what the document's own metadata can hold; the series index is left as it is."""
    policy = policy or NamingPolicy()
    names = _comic_names(policy)
    date = F.when(F.col("release_date_precision") == "day", F.col("release_date"))
    ids = F.when(F.size("identifiers") > 0, F.to_json("identifiers"))
    values = _filled_map(_entries(("series", names["series"]), ("title", F.col("title")), ("authors", F.array_join("creators", ", ")), ("publisher", F.col("publisher")), ("date", date), ("language", F.col("language")), ("identifiers", ids)))
    folder = render_name(policy.comic_folder, names)
    if policy.comic_specials_subfolder:
        folder = F.when(comic_format().isNotNull(), F.concat(folder, F.lit("/Specials"))).otherwise(folder)
    return _placed(golden, keys, values, folder, F.concat(render_name(policy.comic_file, names), F.lit(".pdf")), _ownership(values, t.no_texts(), F.array(F.lit("series_index"))), "comic")


def project_books(golden: DataFrame, keys: list[str], extension: str = ".epub", policy: NamingPolicy | None = None) -> DataFrame:
    """Book records: edition fields are set, or left if only the work is known, or reported as unresolved."""
    policy = policy or NamingPolicy()
    series = t.filled(F.col("series_title"))
    names = {"title": F.col("title"), "series": series, "series_or_title": F.coalesce(series, F.col("title")), "number": render_sequence(F.col("sequence"), policy.integer_padding), "year": F.substring("publication_date", 1, 4), "author": F.get("creators", F.lit(0)), "format": F.lit(None).cast("string")}
    work = F.col("resolution") == "work_only"
    edition = {"publisher": F.col("publisher"), "date": F.col("publication_date"), "language": F.col("language"), "identifiers": F.when(F.size("identifiers") > 0, F.to_json("identifiers"))}
    values = _filled_map(_entries(("title", F.col("title")), ("authors", F.array_join("creators", ", ")), ("series", series), ("series_index", F.col("sequence.normalized")), *((k, F.when(~work, v)) for k, v in edition.items())))
    fields = F.array(*map(F.lit, edition))
    kept = F.concat(F.when(work, fields).otherwise(t.no_texts()), F.array(*map(F.lit, ("manifest", "spine", "cover", "custom_metadata"))))
    open_ = F.array_compact(F.array(*(F.when(~work & (F.coalesce(v, F.lit("")) == ""), F.lit(k)) for k, v in edition.items())))
    filename = F.when(series.isNotNull(), render_name(policy.book_series_file, names)).otherwise(render_name(policy.book_file, names))
    return _placed(golden, keys, values, render_name(policy.book_folder, names), F.concat(filename, F.lit(_dotted(extension))), _ownership(values, t.no_texts(), kept, open_), "book")


def _dotted(extension: str) -> str:
    return extension if extension.startswith(".") else f".{extension}"


def route_transform(rows: DataFrame, convert: bool = True, path: str = "path", format: str = "format", kind: str = "media_kind") -> DataFrame:
    """``rows`` with ``transformation``, ``projection``, ``verification`` and ``route_error`` by source format."""
    f = F.col(format)
    transformation = F.when((f == "cbr") & F.lit(convert), "cbr_to_cbz").when((f == "pdf") & (F.col(kind) == "comic"), "pdf_comic_metadata").when((f == "cbz") & ~F.lower(F.col(path)).endswith(".cbz"), "zip_comic_to_cbz").when(f != "cbr", "metadata_only")
    projection = F.when((f == "pdf") & (F.col(kind) == "comic"), "comic_pdf").otherwise(F.col(kind))
    info = ["comicinfo_profile_validation", "comicinfo_extension_preservation"]
    needs = {"cbr": ["archive_inventory", "payload_byte_preservation", *info], "cbz": ["archive_inventory", *info], "epub": ["archive_inventory"], "pdf": ["pdf_semantic_preservation"]}
    common = ["source_sha256", "metadata_readback", "destination_verification"]
    listed = F.array(*map(F.lit, common))
    for name, more in needs.items():
        listed = F.when(f == name, F.array(*map(F.lit, common + more))).otherwise(listed)
    return rows.withColumn("transformation", transformation).withColumn("projection", projection).withColumn("verification", listed).withColumn("route_error", F.when(transformation.isNull(), "conversion is disabled and writing in place is unsupported"))
