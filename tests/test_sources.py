"""Inventories on real files, feeds, XML, sinks, and the registry."""

import hashlib
import subprocess
import sys


from pyspark.sql import functions as F

from tallyweave.plans.queries import ORACLE_SQL, QUERIES
from tallyweave.sources import feeds, inventory, sinks, xml


def test_inventory(spark, tmp_path):
    files = {"a.epub": b"PK\x03\x04x", "b.cbz": b"PK\x05\x06", "c.pdf": b"%PDF-1.7", "d.rar": b"Rar!\x1a\x07\x01\x00", "e.cbr": b"junk", "skip/f.pdf": b"%PDF-", "g.txt": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    roots = spark.createDataFrame([(f"file:{tmp_path}/skip",)], "root string")
    rows = inventory.with_sha256(inventory.with_signature(inventory.inventory(spark, str(tmp_path), roots))).collect()
    got = {r.path.rsplit("/", 1)[1]: r for r in rows}
    assert {k: (r.signature, r.format) for k, r in got.items()} == {"a.epub": ("zip-epub", "epub"), "b.cbz": ("zip", "cbz"), "c.pdf": ("pdf", "pdf"), "d.rar": ("rar", "cbr"), "e.cbr": ("unknown", "unknown")}
    assert got["c.pdf"].sha256 == hashlib.sha256(files["c.pdf"]).hexdigest() and got["c.pdf"].size == 8
    listing = spark.createDataFrame([("p",), ("q",)], "path string")
    prints = spark.createDataFrame([("p", "h", "pdf", "pdf")], "path string, sha256 string, signature string, format string")
    assert {(r.path, r.sha256, r.signature) for r in inventory.with_failures(listing, prints).collect()} == {("p", "h", "pdf"), ("q", "", "unreadable")}


def test_comic_feed(spark):
    issue = '{"id": 1145497, "resource_type": "issue", "api_detail_url": "https://x/api/issue/4000-1145497/", "name": "N", "issue_number": "14", "cover_date": "2026-01-01", "store_date": "2025-11-26", "volume": {"id": 160294, "name": "Absolute Batman", "start_year": "2024"}, "person_credits": [{"name": "Ann", "role": "colorist, cover"}, {"name": "", "role": "x"}]}'
    rows = [('{"results": [%s, {"id": 5, "name": "Run", "start_year": "1999b"}, {"name": "no id"}]}' % issue,), ('{"results": %s}' % issue.replace("1145497", "7").replace('"name": "N"', '"name": "N", "format": "TPB"'),), ('{"other": 1}',), ("not json",)]
    good, bad = feeds.normalize_comic_feed(spark.createDataFrame(rows, "payload string"))
    got = {r.provider_id: r for r in good.collect()}
    a = got["4000-1145497"]
    assert (a.record_type, a.run_id, a.release_date, a.release_date_precision, a.cover_date, a.cover_date_precision, a.run_start_year, a.sequence.normalized) == ("comic_issue", "4050-160294", "2025-11-26", "day", "2026-01", "month", 2024, "14")
    assert [(c.name, c.role) for c in a.creators] == [("Ann", "colorist"), ("Ann", "cover-artist")] and a.provider_metadata["release_date_source"] == "store_date"
    assert (got["4000-7"].record_type, got["4000-7"].item_type) == ("comic_collection", "collected-edition")
    assert (got["4050-5"].record_type, got["4050-5"].run_start_year, got["4050-5"].run_id) == ("comic_run", 1999, "4050-5")
    assert bad.count() == 2


def test_book_feeds(spark):
    rows = [('{"items": [{"id": "v", "volumeInfo": {"title": "T", "authors": ["A"], "industryIdentifiers": [{"type": "ISBN_10", "identifier": "1"}]}}, {"id": "w"}]}',), ("{bad",)]
    good, bad = feeds.normalize_volume_feed(spark.createDataFrame(rows, "payload string"))
    r = good.first()
    assert (r.record_type, r.identifiers[0].scheme, r.creators[0].role) == ("book_edition", "isbn_10", "author") and good.count() == 1 and bad.count() == 1
    doc = '{"docs": [{"key": "/works/OL1W", "title": "T", "author_name": ["A"], "first_publish_year": 1999, "isbn": ["1", ""], "editions": {"docs": [{"key": "/books/OL2M", "title": "E"}, {"key": "/books/OL2X", "title": "F"}]}}, {"key": "", "title": "x"}]}'
    df = spark.createDataFrame([(doc,), ('{"x": 1}',)], "payload string")
    good, bad = feeds.normalize_work_feed(df)
    assert [(r.provider_id, r.publication_date, len(r.identifiers)) for r in good.collect()] == [("works/OL1W", "1999", 1)] and bad.count() == 1
    editions, _ = feeds.normalize_work_feed(df, editions=True)
    assert [(r.provider_id, r.work_id, r.creators[0].name) for r in editions.collect()] == [("OL2M", "works/OL1W", "A")]
    single = '{"key": "/books/OL9M", "title": "T", "isbn_10": ["1"], "isbn_13": ["2"], "publishers": ["P", "Q"], "languages": [{"key": "/languages/eng"}], "works": [{"key": "/works/OL1W"}]}'
    good, bad = feeds.normalize_edition_feed(spark.createDataFrame([(single,), ('{"key": "/works/OL1W", "title": "W"}',), ('{"title": "x"}',)], "payload string"))
    got = {r.provider_id: r for r in good.collect()}
    assert (got["OL9M"].language, got["OL9M"].publisher, [i.value for i in got["OL9M"].identifiers], got["OL9M"].work_id) == ("eng", "P", ["1", "2"], "works/OL1W")
    assert got["works/OL1W"].record_type == "book_work" and bad.count() == 1


def test_xml(spark):
    rows = [("ok", "<ComicInfo><Title> Origin </Title><Series>Example</Series><Number>1A</Number><Other>x</Other></ComicInfo>"), ("two", "<ComicInfo><Series>a</Series><Series>b</Series></ComicInfo>"), ("root", "<Other/>"), ("bad", "<ComicInfo><Title>"), ("null", None)]
    got = {r.path: r for r in xml.comicinfo_fields(spark.createDataFrame(rows, "path string, xml string")).collect()}
    assert (got["ok"].Title, got["ok"].Series, got["ok"].Number, got["ok"].Year, got["ok"].xml_error) == ("Origin", "Example", "1A", None, None)
    assert got["two"].xml_error == "duplicate field: Series" and got["root"].xml_error == "wrong root element" and got["bad"].xml_error and got["null"].xml_error
    opf = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata><dc:title>Fixture Book</dc:title><dc:creator opf:role="aut">A</dc:creator><dc:contributor id="t">T</dc:contributor><dc:subject>s1</dc:subject><dc:subject>s2</dc:subject><meta property="role" refines="#t">trl</meta><meta property="belongs-to-collection" id="c">EPUB3 Series</meta><meta property="group-position" refines="#c">2.5</meta><meta name="calibre:series" content="Old"/></metadata></package>'
    r = xml.opf_fields(spark.createDataFrame([("a", opf)], "path string, xml string")).first()
    assert (r.title, r.creators, r.contributors, r.subjects, r.series, r.series_index, r.xml_error) == ("Fixture Book", ["A"], {"aut": ["A"], "trl": ["T"]}, ["s1", "s2"], "EPUB3 Series", "2.5", None)
    assert xml.opf_fields(spark.createDataFrame([("a", "<x"), ("b", None)], "path string, xml string")).where("xml_error is not null").count() == 2


def test_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("s", "k", 1, 90.0, 5.0, True, False, [("title", 1.0)])], "source_id string, candidate_key string, rank int, score double, runner_up_margin double, eligible boolean, hard_contradiction boolean, comparisons array<struct<field: string, score_delta: double>>")
    for run in ("r1", "r2", "r1"):
        sinks.write_scores(scores, str(tmp_path / "scores"), run)
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "scores")).collect()) == ["r1", "r2"]
    plans = spark.createDataFrame([('{"schema_version":1,"items":[]}',), ("{x",)], "canonical_json string")
    sinks.export_plans(plans, str(tmp_path / "plans"))
    good, bad = sinks.import_plans(spark, str(tmp_path / "plans"))
    assert [r.status for r in good.collect()] == ["draft"] and bad.count() == 1
    hashed = sinks.with_hashes(spark.createDataFrame([("t", [])], "title string, edition_qualifiers array<string>"), ["title", "edition_qualifiers"])
    plain = sinks.with_hashes(spark.createDataFrame([("t",)], "title string"), ["title"])
    assert hashed.first().evidence_hash == plain.first().evidence_hash


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 50


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """Without the subpackage and the pipeline the entry still imports and lists the other queries."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tallyweave"), tmp_path / "tallyweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'best_match' in q and not any(n.startswith('op') for n in q if n[2:3].isdigit()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_scanned_folders(spark, tmp_path):
    """Links are skipped, files of any size hashed, broken ones reported, whatever the number of partitions."""
    import hashlib
    import os

    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    big = os.urandom(3 * (1 << 20) + 17)
    (deep / "big.cbz").write_bytes(big)
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "a" / "empty.epub").write_bytes(b"")
    (tmp_path / "a" / "note.txt").write_bytes(b"no media")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "y.cbz").write_bytes(b"PK\x03\x04")
    (tmp_path / "a" / "link.cbz").symlink_to(tmp_path / "out" / "y.cbz")
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    for folders in (1, 2, 3, 50):
        rows = {r.path.removeprefix(f"{tmp_path}/"): r for r in inventory.scanned(spark, str(tmp_path), [str(tmp_path / "out")], folders).collect()}
        assert set(rows) == {"a/b/c/big.cbz", "a/x.pdf", "a/empty.epub"}
        assert (rows["a/b/c/big.cbz"].sha256, rows["a/b/c/big.cbz"].size) == (hashlib.sha256(big).hexdigest(), len(big))
        assert rows["a/x.pdf"].format == "pdf" and rows["a/empty.epub"].sha256 == hashlib.sha256(b"").hexdigest()
    missing = inventory.scanned(spark, str(tmp_path / "nowhere")).collect()
    assert [(r.signature, r.sha256, r.format) for r in missing] == [("unreadable", "", "unknown")] and missing[0].error
    limited = inventory.inventory(spark, str(tmp_path / "a"), max_bytes=100)
    hashed = {r.path.rsplit("/", 1)[1]: r for r in inventory.with_failures(limited.select("path"), inventory.with_sha256(inventory.with_signature(limited))).collect()}
    assert (hashed["big.cbz"].signature, hashed["big.cbz"].sha256) == ("unreadable", "") and hashed["x.pdf"].signature == "pdf"


def test_torn_exports_are_refused(spark, tmp_path):
    plans = spark.createDataFrame([(f'{{"schema_version":1,"items":[],"k":{i}}}',) for i in range(20)], "canonical_json string").repartition(3)

    def problems(tear):
        path = str(tmp_path / tear.__name__)
        sinks.export_plans(plans, path)
        assert sinks.export_problems(spark, path).count() == 0 and sinks.import_plans(spark, path)[0].count() == 20
        tear(tmp_path / tear.__name__)
        good, bad = sinks.import_plans(spark, path)
        assert good.count() == 0 and all("torn export" in r.reasons for r in bad.collect())
        told = {r.problem for r in sinks.export_problems(spark, path).collect()}
        sinks.export_plans(plans, path)  # a whole export mends it
        assert sinks.import_plans(spark, path)[0].count() == 20
        return told

    def parts(path):
        return sorted(p for p in (path / "data").iterdir() if p.name.startswith("part") and p.stat().st_size)

    def lost(path):
        parts(path)[0].unlink()

    def changed(path):
        first = parts(path)[0]
        first.write_text(first.read_text().replace('"k":', '"j":'))
        (first.parent / f".{first.name}.crc").unlink()

    def unsealed(path):
        for p in sorted((path / "seal").iterdir()):
            p.unlink()
        (path / "seal").rmdir()

    def resealed(path):
        for p in (path / "seal").iterdir():
            if p.name.startswith("part"):
                p.write_text("1:1\n")
            if p.name.endswith(".crc"):
                p.unlink()

    assert problems(lost) == {"file is missing"} and problems(changed) == {"file was changed"} and problems(unsealed) == {"no seal"} and problems(resealed) == {"manifest does not match its seal"}


def test_united_arrays_keep_their_order(spark):
    from tallyweave.operators import golden

    rows = [("a", 3, "X"), ("a", 1, "y"), ("a", 2, "x"), ("a", 1, "b"), ("b", 1, None), ("b", 2, "z"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, place int, v string").repartition(5)
    got = {r.k: [x.v for x in r["items"]] for r in golden.ordered_distinct(df, ["k"], ["place"], {"v": F.col("v")}, ("v",)).collect()}
    assert got == {"a": ["b", "y", "x"], "b": ["z"], None: ["n"]}
