"""Substring dedup by line and sentence hashing.

Each text is cut into units by its content alone, so that a passage falls into the same units wherever it is set, from its
first cut on: lines, in a line sentences, and in a sentence of over ``LONG_WORDS`` words what ends with a word whose digest
says so. Lines and sentences of fewer than ``LONE_WORDS`` words go together up to one whose digest says so. Units are normalised and hashed; digests are grouped globally; the earliest ranked occurrence stays. What repeats one is
removed from its text, with its original offsets kept, if the units that repeat behind each other have ``RUN_WORDS`` words or
more: a short sentence or heading that two texts share is no passage.

Only digests, ranks and offsets are shuffled: digests are counted with partial sums, then only units that repeat are ranked; the
texts meet the removed spans by row digest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import Put, free_name, scratch, written

#: A run of repeated units with fewer words is never removed.
RUN_WORDS = 25
#: A sentence of more words is cut behind words of which one in ``CUT`` is chosen.
LONG_WORDS, CUT = 24, 8
#: A line or sentence of so many words is a unit by itself; of shorter ones one in ``CLOSING`` ends a unit.
LONE_WORDS, CLOSING = 8, 2
#: Bytes that count as a word at least, for writing without spaces.
WORD_BYTES = 9

_PIECE = re.compile(r"(?:[^\n.!?…。！？]++|[.!?…]++[\"'»”)\]]*+(?![ \t\n]|\Z))*+(?:[.!?…]++[\"'»”)\]]*+|[。！？]++)?+[ \t]*+")
_WORD = re.compile(r"\S+\s*")


def normal(unit: str) -> str:
    """NFKC, case folded, words joined by one space."""
    return " ".join((unit.lower() if unit.isascii() else unicodedata.normalize("NFKC", unit).casefold()).split())


def n_words(unit: str) -> int:
    """Words of a unit; a stretch without spaces counts by its bytes."""
    return max(unit.count(" ") + 1, len(unit.encode()) // WORD_BYTES)


def pieces(text: str) -> Iterator[tuple[int, int, str, bool, bool]]:
    """(start, end, normalised text, whether it is long, whether a unit ends with it) of lines, sentences and parts of long sentences."""
    for piece in _PIECE.finditer(text):
        raw = piece.group()
        whole = normal(raw)
        if not whole:
            continue
        start = piece.start() + len(raw) - len(raw.lstrip())
        end = piece.start() + len(raw.rstrip())
        words = whole.count(" ") + 1
        if words <= LONG_WORDS:
            yield start, end, whole, words >= LONE_WORDS, words < LONE_WORDS and crc32(whole.encode()) % CLOSING == 0
            continue
        for word in _WORD.finditer(text, start, end):
            if crc32(normal(word.group()).encode()) % CUT == 0 and word.end() < end:
                part = text[start : word.end()]
                yield start, start + len(part.rstrip()), normal(part), True, True
                start = word.end()
        yield start, end, normal(text[start:end]), True, True


def units(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of the units, in order, without the white space around; offsets in code points."""
    start, end, held = 0, 0, []
    for a, b, whole, long, closes in pieces(text):
        if held and long:
            yield start, end, " ".join(held)
            held.clear()
        if not held:
            start = a
        held.append(whole)
        end = b
        if long or closes:
            yield start, end, " ".join(held)
            held.clear()
    if held:
        yield start, end, " ".join(held)


def unit_rows(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with an array column of (digest, digest2, start, end, words) of each unit; none for null or empty texts."""

    @F.arrow_udf("array<struct<h: long, h2: long, start: int, end: int, words: int>>")
    def of(texts: pa.Array) -> pa.Array:
        digests, rows, sizes = [], [], [0]
        for t in texts:
            for s, e, u in units(t.as_py() or ""):
                digests.append(xxhash.xxh3_128_digest(u.encode()))
                rows.append((s, e, n_words(u)))
            sizes.append(len(rows))
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        n = np.array(rows, np.int32).reshape(-1, 3)
        values = pa.StructArray.from_arrays([pa.array(x) for x in (h[:, 0], h[:, 1], n[:, 0], n[:, 1], n[:, 2])], ["h", "h2", "start", "end", "words"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)

    return df.withColumn(out, of(F.col(f"`{text}`")))


def repeats(df: DataFrame, put: Put, key: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """(d, k, spans): for each distinct row (key k, text digest d), the spans that repeat an earlier ranked unit.

    Rank is by key (nulls last), then text digest, then offset. ``spans`` is an array of (start, end, first_key,
    first_start), by start: the removed place and where its kept occurrence is. Repeats in a run of fewer than ``run_words``
    words are left out.
    """
    named = df.select(F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("d"), F.col(f"`{text}`").alias("t"))
    cut = unit_rows(named, "t", "units").select("k", "d", "units").where(F.size("units") > 0)
    rows = put(cut.select("k", "d", F.posexplode("units").alias("i", "u")).select("k", "d", "i", "u.*"), "units")
    # digests are counted by themselves: two longs and a count aggregate in a hash table, and most units stand once and go here;
    # written, so that Spark sees its size and can split the rows of a very common unit in the joins
    common = put(rows.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h", "h2"), "common")
    again = put(rows.join(common, ["h", "h2"]), "again")
    rank = F.struct(F.isnull("k").alias("none"), F.col("k").alias("k"), F.col("d").alias("d"), F.col("i").alias("i"), F.col("start").alias("start"))
    firsts = put(again.groupBy("h", "h2").agg(F.min(rank).alias("first")), "firsts")
    later = again.join(firsts, ["h", "h2"]).where(~((F.col("first.none") == F.isnull("k")) & F.col("first.k").eqNullSafe(F.col("k")) & (F.col("first.d") == F.col("d")) & (F.col("first.i") == F.col("i"))))
    span = F.struct("i", "start", "end", "words", F.col("first.k").alias("first_key"), F.col("first.start").alias("first_start"))
    found = later.groupBy("k", "d").agg(F.sort_array(F.collect_set(span)).alias("all"))

    @F.arrow_udf("array<boolean>")
    def long(places: pa.Array, words: pa.Array) -> pa.Array:
        i, n, sizes = np.asarray(places.flatten()), np.asarray(words.flatten()), np.asarray(places.value_lengths())
        new = np.diff(i, prepend=-2) != 1
        new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        run = np.cumsum(new) - 1
        keep = np.bincount(run, n)[run] >= run_words if len(i) else np.empty(0, bool)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keep, pa.bool_()))

    flagged = found.withColumn("long", long(F.transform("all", lambda x: x["i"]), F.transform("all", lambda x: x["words"])))
    spans = F.transform(F.filter("all", lambda x, n: F.get(F.col("long"), n)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["first_key"].alias("first_key"), x["first_start"].alias("first_start")))
    return flagged.select("k", "d", spans.alias("spans")).where(F.size("spans") > 0)


def without(text: Column, starts: Column, ends: Column) -> Column:
    """``text`` without the stretches from ``starts`` to ``ends``, in order; null for null. A native substring would count from the
    start of the text for every stretch."""

    @F.arrow_udf("string")
    def of(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = []
        for t, b, e in zip(texts, starts, ends, strict=True):
            whole = t.as_py()
            rows.append(whole and "".join(whole[x:y] for x, y in zip([0, *e.as_py()], [*b.as_py(), None], strict=True)))
        return pa.array(rows, pa.string())

    return of(text, starts, ends)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", out: str | None = None, spans: str = "removed", run_words: int = RUN_WORDS) -> DataFrame:
    """``df`` with repeated units cut out of ``text`` (or into ``out``), and the removed spans in an array column.

    Cut spans are replaced by nothing; the white space around them stays. Null texts stay null, with no spans; all
    rows stay, a text of repeats only keeps its white space. Rows that repeat both key and text are one row
    in rank: the later ones would be equal in every respect, so all keep the earliest occurrence. Columns that clash with
    ``spans`` give it an underscore.
    """
    out, spans = out or text, free_name(df, spans)
    digest, k, d = (free_name(df, x) for x in ("_digest", "_k", "_d"))
    with scratch(df.sparkSession) as put:
        found = written(repeats(df, put, key, text, run_words), "spans").select(F.col("k").alias(k), F.col("d").alias(d), F.col("spans").alias(spans))
    met = df.withColumn(digest, F.xxhash64(F.col(f"`{text}`"))).join(found, F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.col(digest) == F.col(d)), "left")
    first_kind = dict(found.dtypes)[spans]
    cuts = F.coalesce(F.col(spans), F.array().cast(first_kind))
    some = F.size(cuts) > 0
    # texts without spans do not go to Python
    rest = without(F.when(some, F.col(f"`{text}`")), F.transform(cuts, lambda s: s["start"]), F.transform(cuts, lambda s: s["end"]))
    cleaned = F.when(some, rest).otherwise(F.col(f"`{text}`"))
    return met.select(*(F.col(f"`{c}`") for c in df.columns if c != out), cleaned.alias(out), cuts.alias(spans))
