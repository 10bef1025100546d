"""Sequence numbers: issue, volume and book numbers as sortable structs.

A struct has ``raw``, ``normalized``, ``kind``, ``sort_key`` (kind 0 to 4, number, text) and ``width``. Structs order field by
field, so ``sort_key`` can stand in ``orderBy``, ``max`` and ``max_by``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("integer", "decimal", "alphanumeric", "range", "symbolic")
TYPE = "struct<raw: string, normalized: string, kind: string, sort_key: struct<k: int, n: bigint, t: string>, width: int>"


def sequence_struct(c: Column) -> Column:
    """The sequence of a text; null (an error) for null and blank ones. Numbers beyond 18 digits have no sort number."""
    raw = F.trim(c)
    number = lambda x: x.try_cast("bigint")
    plain = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    part = lambda p, i: F.regexp_extract(raw, p, i)
    decimal, letters, span = r"^(\d+)\.(\d+)$", r"^(\d+)([A-Za-z]+)$", r"^(\d+)\s*-\s*(\d+)$"
    fraction = F.rtrim(part(decimal, 2), F.lit("0"))
    fraction = F.when(fraction == "", "0").otherwise(fraction)
    symbol = F.upper(F.regexp_replace(raw, r"(?U)\s+", " "))

    def of(k: int, normalized: Column, n: Column, t: Column, width: Column) -> Column:
        key = F.struct(F.lit(k).alias("k"), n.alias("n"), t.alias("t"))
        return F.struct(raw.alias("raw"), normalized.alias("normalized"), F.lit(KINDS[k]).alias("kind"), key.alias("sort_key"), width.alias("width")).cast(TYPE)

    none, zero = F.lit(None).cast("int"), F.lit(0).cast("bigint")
    end = plain(part(span, 2))
    return (
        F.when(raw.rlike(r"^\d+$"), of(0, plain(raw), number(raw), F.lit(""), F.length(raw)))
        .when(raw.rlike(decimal), of(1, F.concat_ws(".", plain(part(decimal, 1)), fraction), number(part(decimal, 1)), F.rpad(fraction, F.greatest(F.length(fraction), F.lit(18)), F.lit("0")), none))
        .when(raw.rlike(letters), of(2, F.concat(plain(part(letters, 1)), F.upper(part(letters, 2))), number(part(letters, 1)), F.lower(part(letters, 2)), none))
        .when(raw.rlike(span), of(3, F.concat_ws("-", plain(part(span, 1)), end), number(part(span, 1)), F.lpad(end, F.greatest(F.length(end), F.lit(9)), F.lit("0")), none))
        .when(raw != "", of(4, symbol, zero, F.lower(symbol), none))
    )


def render_sequence(sequence: Column, minimum: int = 3) -> Column:
    """Integers padded with zeros to the larger of ``minimum`` and their original width; others as normalised."""
    normal = sequence["normalized"]
    width = F.greatest(F.lit(minimum), F.coalesce(sequence["width"], F.lit(0)), F.length(normal))
    return F.when(sequence["kind"] == "integer", F.lpad(normal, width, F.lit("0"))).otherwise(normal)
