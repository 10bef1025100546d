"""Golden rows of the standardisation functions."""

from pyspark.sql import functions as F

from tallyweave.functions import names, ratio, sequence, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_sequences(spark):
    rows = [("1", "1", "integer", "001"), ("001", "1", "integer", "001"), ("0.5", "0.5", "decimal", "0.5"), ("70.5", "70.5", "decimal", "70.5"), ("1.50", "1.5", "decimal", "1.5"), ("1.0", "1.0", "decimal", "1.0"), ("1A", "1A", "alphanumeric", "1A"), ("1-5", "1-5", "range", "1-5"), ("TPB1", "TPB1", "symbolic", "TPB1"), (" 0012 ", "12", "integer", "0012")]
    got = spark.createDataFrame(rows, "raw string, n string, k string, r string").withColumn("s", sequence.sequence_struct(F.col("raw"))).withColumn("got", sequence.render_sequence(F.col("s"))).collect()
    assert all((r.s.normalized, r.s.kind, r.got) == (r.n, r.k, r.r) for r in got), got
    assert one(spark, sequence.sequence_struct(F.col("a")), a="  ") is None
    a, b = (one(spark, sequence.sequence_struct(F.col("a")), a=x).sort_key for x in ("0.05", "0.5"))
    assert a < b


def test_names(spark):
    rows = [
        ("Comics/Lantern Harbor 014 (2026) (Digital) (Tern-Empire).cbz", "issue", "Lantern Harbor", "14", None),
        ("Comics/Copper Fox by Mara Quill Book 01 (2020).cbr", "collected-edition", "Copper Fox", "1", "Mara Quill"),
        ("Comics/Then Again - V1 - 024 - The Ferry That Came Back.pdf", "issue", "Then Again", "24", None),
        ("Comics/Night Tram/Night Tram #1.pdf", "issue", "Night Tram", "1", None),
        ("Comics/Glass Orchard - The Amber Winter (2026) (digital) (Heron Row-Empire).cbr", "one-shot", "Glass Orchard - The Amber Winter", None, None),
        ("Driftwood v02 (2013) (Digital-TPB) (Tern-Empire).cbr", "collected-edition", "Driftwood", "2", None),
        ("Salt-Road - Long Way (2021, 2nd edition) (Digital) (Tern-Empire).cbr", "collected-edition", "Salt-Road - Long Way", None, None),
        ("Kestrel Annual.cbz", "annual", "Kestrel Annual", None, None),
        ("Marrow - The Complete Tale in One Volume.cbz", "collected-edition", "Marrow", None, None),
        (None, "one-shot", None, None, None),
    ]
    df = spark.createDataFrame(rows, "path string, subtype string, series string, seq string, creator string")
    for r in names.parse_comic_names(df).collect():
        c = r.comic
        assert (c.subtype, c.series, c.sequence and c.sequence.normalized, (c.creators or [None])[0]) == (r.subtype, r.series, r.seq, r.creator), r
        if r.path and r.path.startswith("Salt-Road"):
            assert (c.title, c.year, c.edition_qualifiers) == ("2nd edition", 2021, ["2nd edition"])
        if r.path and r.path.startswith("Driftwood"):
            assert (c.title, c.year) == ("Volume 2", 2013)


def test_book_names_and_classes(spark):
    rows = [("Books/The Slow River by Ines Falk.epub", "epub", "book", "standalone-book", "Ines Falk"), ("Books/Loom Handbook Odile Brandt.epub", "epub", "book", "standalone-book", "Odile Brandt"), ("Books/The Small Weaving Handbook 2023.pdf", "pdf", "book", "standalone-book", None), ("Comics/Night Tram/Night Tram #1.pdf", "pdf", "comic", "issue", None), ("x.zip", "zip", "unknown", "unknown", None)]
    df = spark.createDataFrame(rows, "path string, format string, kind string, subtype string, creator string")
    got = names.classify(names.parse_book_names(names.parse_comic_names(df))).collect()
    for r in got:
        c = r.classification
        assert (c.kind, c.subtype) == (r.kind, r.subtype), r
        assert r.creator is None or c.hypotheses[0].creators == [r.creator]
    assert got[2].book.year == 2023 and got[2].book.title == "The Small Weaving Handbook"


def test_long_archives_are_ambiguous(spark):
    df = spark.createDataFrame([("Epic by Ann Lee.cbz", "cbz", 200)], "path string, format string, pages int")
    c = names.classify(names.parse_book_names(names.parse_comic_names(df)), page_count="pages").first().classification
    assert (c.subtype, c.confidence, c.ambiguous, [h.confidence for h in c.hypotheses]) == ("collected-edition", 0.78, True, [0.78, 0.72])
    assert c.hypotheses[0].creators == ["Ann Lee"] and c.hypotheses[0].series == "Epic"


def test_text_keys(spark):
    assert one(spark, text.title_key(F.col("a")), a="Bread & Rivers!") == "bread rivers"
    folded = spark.createDataFrame([(x,) for x in text.FOLDED], "a string").select("a", text.casefold(F.concat(F.lit("X"), "a")).alias("x")).collect()
    assert all(r.x == ("X" + r.a).casefold() for r in folded)
    assert one(spark, text.title_key(F.col("a")), a="Alte Stra\u00dfe: \ufb01n") == "alte strasse fin"
    assert one(spark, text.publisher_key(F.col("a")), a="Tern Comics, Inc.") == "tern"
    assert one(spark, text.collection_title_key(F.col("a")), a="Driftwood Vol. Two: Book IV") == "driftwood volume 2 book 4"
    assert one(spark, text.volume_number(F.col("a"), F.col("b")), a="Saga", b="Volume 03") == "3"
    assert one(spark, text.edition_qualifiers(F.col("a"), F.col("b")), a="X: Deluxe  Edition omnibus", b="Omnibus") == ["Deluxe Edition", "omnibus"]
    assert one(spark, text.split_names(F.col("a")), a="A B, C; D and E & F") == ["A B", "C", "D", "E", "F"]
    assert one(spark, text.clean_title(F.col("a")), a=" a_b  - c -") == "a b - c"
    assert one(spark, text.isbn_valid(F.col("a")), a="9780140268867") and one(spark, text.isbn_valid(F.col("a")), a="080442957X")
    assert not one(spark, text.isbn_valid(F.col("a")), a="9780140268868") and not one(spark, text.isbn_valid(F.col("a")), a="")
    assert one(spark, text.run_group_key(F.col("a")), a="!!") is None
    assert one(spark, text.credit_base(F.col("a")), a="Winter Song By Quill & Da Rosa") == "winter song"
    assert one(spark, text.credit(F.col("a")), a="Tern by Gaslight") is None


def test_natural_sort(spark):
    df = spark.createDataFrame([("p10",), ("p2",), ("p",), ("1",)], "n string")
    assert [r.n for r in df.orderBy(text.natural_sort_key(F.col("n"))).collect()] == ["1", "p", "p2", "p10"]


def test_tokens(spark):
    df = spark.createDataFrame([("d/Saga #002 (2013, deluxe edition) (digital) www.site.com.cbz",)], "path string")
    got = {(r.kind, r.raw) for r in names.filename_tokens(df).collect()}
    assert {("year", "2013"), ("edition-qualifier", "deluxe edition"), ("release-noise", "digital"), ("sequence", "002"), ("text", "Saga"), ("release-noise", "www.site.com")} <= got
    assert names.evidence_long(df).where("field = 'folder'").first().raw == "d"


def test_ratio_matches_reference_library(spark):
    from difflib import SequenceMatcher

    pairs = [("abcd", "bcde"), ("", ""), ("x", ""), ("private thread", "privat thrd")]
    got = ratio.with_ratios(spark.createDataFrame(pairs, "a string, b string"), {"r": (F.col("a"), F.col("b"))}, ["a", "b"]).collect()
    assert all(abs(r.r - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12 for r in got)
