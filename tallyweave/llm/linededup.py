"""Line dedup by site-relative frequency, in DataFrame functions.

For each host the pages that contain a line are divided by the host's pages; lines above the boilerplate ratio go.
Only 64-bit digests of lines are shuffled for the counts, never their text. A hot host or line is counted by partial sums
before the shuffle; a host's list of boilerplate is a written table, so Spark sends it to the pages where it is small and
else splits the pages of a hot host over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import SPACE, SPACE_CHARS, Put, free_name, scratch, written

#: Lines in a larger share of a host's pages are boilerplate.
RATIO = 0.1
#: A line on fewer pages of its host than this is never boilerplate: on one page alone it repeats nowhere.
MIN_PAGES = 2

#: Tags that end a line of a page, and what of it is not shown.
BREAKS = r"(?i)<br[^<>]*>|</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|html|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:\s[^<>]*)?>"
HIDDEN = r"(?is)<!--.*?-->|<script[\s>].*?</script>|<style[\s>].*?</style>"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.nullif(host, F.lit("")))


def visible_lines(html: Column) -> Column:
    """The text of a page with a line for each block: comments, scripts, styles and tags removed."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAKS, "\n"), "<[^<>]*>", "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(F.btrim(x, F.lit(SPACE_CHARS)), f"[{SPACE}]+", " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _normal(line: Column) -> Column:
    return F.regexp_replace(F.btrim(line, F.lit(SPACE_CHARS)), f"[{SPACE}]+", " ")


def _digests(text: Column, normalised: bool) -> Column:
    """A 64-bit digest of each line of a text, null for blank lines."""
    lines = F.split(text, "\n")
    return F.transform(lines if normalised else F.transform(lines, _normal), lambda x: F.when(x != "", F.xxhash64(x)))


def boilerplate(df: DataFrame, host: str, lines: str, put: Put, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, digest) of the lines in over ``ratio`` of the host's pages and on at least ``min_pages`` of them.

    ``lines`` is a column of line digests. At most lines per page / ratio such lines exist per host. With ``copies_once``
    pages of a host with the same sequence of lines count once, so a page that was copied a thousand times does not turn
    its own text into boilerplate.
    """
    pages = df.select(F.col(host).alias("host"), F.array_distinct(F.array_compact(lines)).alias("digests"), F.xxhash64(F.array_compact(lines)).alias("page"))
    if copies_once:
        pages = pages.groupBy("host", "page").agg(F.first("digests").alias("digests"))
    pages = put(pages.select("host", "digests"), "pages")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    on = pages.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    same = on.host.eqNullSafe(totals.host)
    return on.join(totals, same).where(F.col("n") > ratio * F.col("pages")).select(on.host, "digest")


def deduplicated(df: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, out: str | None = None, copies_once: bool = False, normalised: bool = False) -> DataFrame:
    """``df`` with boilerplate lines removed from ``text`` (or in ``out``) and the counts ``n_lines`` and ``n_dropped``.

    Lines compare trimmed and with runs of white space as one space (``normalised`` says that they already are so); lines
    without a word are never dropped. A null host is a host of its own. A null text stays null with zero lines, an
    empty text stays empty. All rows stay, a text of boilerplate only becomes empty. Repeated rows are treated alike; an empty
    table gives an empty result. Counts that clash with a column of ``df`` get an underscore. ``df`` is read twice.
    """
    out = out or text
    n_lines, n_dropped = free_name(df, "n_lines"), free_name(df, "n_dropped")
    h, d, drop = (free_name(df, x) for x in ("_host", "_digests", "_drop"))
    rows = df.withColumn(h, host).withColumn(d, F.coalesce(_digests(F.col(f"`{text}`"), normalised), F.array().cast("array<bigint>")))
    with scratch(df.sparkSession) as put:
        common = boilerplate(rows, h, d, put, ratio, min_pages, copies_once)
        # a row per host with its boilerplate: lines per page / ratio entries at most
        of_host = written(common.groupBy("host").agg(F.collect_set("digest").alias(drop)), "boilerplate")
    met = rows.join(of_host, F.col(h).eqNullSafe(of_host.host), "left").drop(of_host.host)
    known = F.coalesce(F.col(drop), F.array().cast("array<bigint>"))
    dropped = F.arrays_overlap(F.col(d), known)
    kept = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: F.coalesce(~F.array_contains(known, F.get(F.col(d), i)), F.lit(True)))
    cleaned = F.when(F.coalesce(dropped, F.lit(False)), F.array_join(kept, "\n")).otherwise(F.col(f"`{text}`"))
    gone = F.size(F.filter(F.col(d), lambda x: F.coalesce(F.array_contains(known, x), F.lit(False))))
    return met.select(*(F.col(f"`{c}`") for c in df.columns if c != out), cleaned.alias(out), F.size(F.array_compact(F.col(d))).cast("long").alias(n_lines), gone.cast("long").alias(n_dropped))
