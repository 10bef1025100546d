"""Golden scenarios of candidate generation, scoring, ranking and reconciliation."""

from pyspark.sql import functions as F

from tallyweave.functions.sequence import sequence_struct
from tallyweave.operators import candidates, compare, rank
from tallyweave.schemas import CANDIDATES, LOCAL


def table(spark, ddl, rows):
    """Rows as dicts; ``sequence`` as text."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(ddl)
    flat = schema.fromJson(schema.jsonValue())
    for f in flat.fields:
        if f.name == "sequence":
            f.dataType = _parse_datatype_string("string")
    df = spark.createDataFrame([tuple(r.get(f.name) for f in flat.fields) for r in rows], flat)
    return df.withColumn("sequence", sequence_struct(F.col("sequence")))


BOOK = {"source_id": "s", "kind": "book", "subtype": "standalone-book", "classification_confidence": 0.98, "title": "The Odyssey", "creators": ["Homer"], "identifiers": [], "edition_qualifiers": []}
EDITION = {"candidate_key": "k1", "provider": "work", "provider_id": "1", "record_type": "book_edition", "media_kind": "book", "title": "The Odyssey", "creators": [("Homer", "author")], "identifiers": [], "provider_metadata": {}}
COMIC = {"source_id": "s", "kind": "comic", "subtype": "issue", "classification_confidence": 0.98, "title": "The Zoo", "series_title": "Absolute Batman", "sequence": "014", "year": 2026, "run_start_year": 2024, "creators": [], "identifiers": [], "edition_qualifiers": []}
ISSUE = {"candidate_key": "k1", "provider": "comic", "provider_id": "1", "record_type": "comic_issue", "media_kind": "comic", "title": "The Zoo", "series_title": "Absolute Batman", "sequence": "14", "run_start_year": 2024, "cover_date": "2026-01", "creators": [], "identifiers": [], "provider_metadata": {}}


def scored(spark, local, *found):
    left, right = table(spark, LOCAL, [local]), table(spark, CANDIDATES, list(found))
    blocked = left.select("source_id").join(right.select("candidate_key")).withColumn("strategy", F.lit("t"))
    rows = rank.with_eligibility(rank.ranked(compare.score_pairs(candidates.pairs(left, right, blocked))))
    return compare.reconcile(rows).orderBy("rank").collect()


def test_exact_identifier_wins(spark):
    isbn = [("isbn", "9780140268867")]
    r = scored(spark, BOOK | {"identifiers": isbn}, EDITION | {"identifiers": [("ISBN", "978-0140268867".replace("-", ""))]})[0]
    assert (r.score, r.runner_up_margin, r.eligible, r.reconciliation.edition_state) == (100.0, 100.0, True, "accepted")


def test_conflicting_identifier_is_hard(spark):
    r = scored(spark, BOOK | {"identifiers": [("isbn", "9780140268867")]}, EDITION | {"identifiers": [("isbn", "9780140449112")]})[0]
    assert r.hard_contradiction and not r.eligible and r.contradictions == ["conflicting exact isbn identifiers"]


def test_similar_title_is_a_work(spark):
    r = scored(spark, BOOK | {"title": "Crime & Punishment", "creators": ["Fyodor Dostoevsky"]}, EDITION | {"record_type": "book_work", "title": "Crime and Punishment", "creators": [("Fyodor Dostoevsky", "author")]})[0]
    assert r.score >= 80 and (r.reconciliation.work_state, r.reconciliation.edition_state) == ("accepted", "unresolved")


def test_comic_issue(spark):
    r = scored(spark, COMIC, ISSUE)[0]
    deltas = {c.field: (c.kind, c.score_delta) for c in r.comparisons}
    assert r.eligible and deltas["sequence"] == ("exact", 30.0) and deltas["issue_title"] == ("exact", 12.0)
    r = scored(spark, COMIC, ISSUE | {"sequence": "15"})[0]
    assert r.hard_contradiction and r.contradictions == ["sequence numbers conflict"]


def test_equal_editions_have_no_margin(spark):
    rows = scored(spark, BOOK, EDITION, EDITION | {"candidate_key": "k2", "provider_id": "2"})
    assert [r.rank for r in rows] == [1, 2] and rows[0].runner_up_margin == 0 and not rows[0].eligible


def test_collections(spark):
    local = COMIC | {"subtype": "collected-edition", "title": "Volume 2", "series_title": "Saga", "sequence": "2", "edition_qualifiers": ["Deluxe Edition"], "publisher": "Image Comics", "run_start_year": None, "year": 2013}
    found = ISSUE | {"record_type": "comic_collection", "title": "Saga: Vol. Two", "subtitle": "Deluxe Edition", "sequence": None, "publisher": "Image", "publication_date": "2013-05", "cover_date": None, "series_title": "Saga", "run_start_year": None}
    r = scored(spark, local, found)[0]
    kinds = {c.field: c.kind for c in r.comparisons}
    assert kinds["edition_qualifier"] == "exact" and kinds["publisher"] == "supporting" and kinds["year"] == "exact" and not r.material_conflicts
    r = scored(spark, local, found | {"subtitle": None, "publication_date": "2001"})[0]
    assert "distinctive local edition qualifier is absent from provider title" in r.material_conflicts and "collection edition years disagree materially" in r.material_conflicts
    assert scored(spark, local, ISSUE)[0].hard_contradiction


def test_explanation(spark):
    left, right = table(spark, LOCAL, [BOOK]), table(spark, CANDIDATES, [EDITION])
    blocked = left.select("source_id").join(right.select("candidate_key")).withColumn("strategy", F.lit("t"))
    rows = rank.with_eligibility(rank.ranked(compare.score_pairs(candidates.pairs(left, right, blocked))))
    lines = rows.select(compare.explanation().alias("x")).first().x
    assert lines[0] == "Candidate k1: score 90.0" and lines[-1].endswith("no")


def test_ladder(spark):
    local = table(spark, LOCAL, [COMIC | {"subtype": "collected-edition", "title": "Volume 2", "series_title": "Saga", "sequence": "2", "creators": ["Ann Lee"]}])
    got = [(r.label, r.title) for r in candidates.collection_ladder(local).orderBy("ordinal").collect()]
    assert ("structured", "Saga Volume 2") in got and ("vol-comma", "Saga, Vol. 2") in got and ("creator-inline", "Saga by Ann Lee Volume 2") in got and ("creator-inline-word-number", "Saga by Ann Lee Volume Two") in got
    assert len({(t.lower(), lab.endswith("title-only")) for lab, t in got}) == len(got)


def test_collection_ladder_stays_in_its_rows(spark):
    """Variants are told apart within the row of their edition: nothing is shuffled or sorted, so no task holds more than a row's."""
    kind = "source_id string, kind string, subtype string, title string, series_title string, creators array<string>, sequence struct<normalized: string>, edition_qualifiers array<string>"
    local = spark.createDataFrame([("a", "comic", "collected-edition", "SAGA", "Saga", [], (None,), ["Omnibus"]), ("b", "comic", "collected-edition", "Volume 2", "Saga", ["Ann Lee"], ("2",), None)], kind)
    ladder = candidates.collection_ladder(local)
    plan = ladder._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Window"))
    got = sorted((r.source_id, r.ordinal, r.label, r.title, r.creators) for r in ladder.collect())
    names = ["Ann Lee"]
    assert got[0] == ("a", 0, "structured", "SAGA", []) and [x[0] for x in got].count("a") == 1
    assert got[1:] == [
        ("b", 0, "structured", "Saga Volume 2", names), ("b", 1, "structured-title-only", "Saga Volume 2", []), ("b", 2, "vol", "Saga Vol. 2", names), ("b", 3, "vol-title-only", "Saga Vol. 2", []), ("b", 4, "vol-comma", "Saga, Vol. 2", names), ("b", 5, "vol-comma-title-only", "Saga, Vol. 2", []),
        ("b", 8, "creator-inline", "Saga by Ann Lee Volume 2", names), ("b", 10, "creator-inline-word-number", "Saga by Ann Lee Volume Two", names),
    ]


def test_tiers(spark):
    local = table(spark, LOCAL, [BOOK | {"source_id": "a", "identifiers": [("isbn", "1")]}, BOOK | {"source_id": "b"}, BOOK | {"source_id": "c", "title": "Odyssey retold"}])
    found = table(spark, CANDIDATES, [EDITION | {"identifiers": [("isbn", "1")], "title": "Other"}, EDITION | {"candidate_key": "k2"}])
    routes = local.select("source_id").withColumn("provider", F.lit("work")).withColumn("outcome", F.lit("search"))
    got = {(r.source_id, r.candidate_key, r.strategy) for r in candidates.tiered_pairs(local, found, routes).collect()}
    assert got == {("a", "k1", "identifier:isbn"), ("b", "k2", "structured"), ("c", "k2", "relaxed")}


def test_runs(spark):
    local = table(spark, LOCAL, [COMIC | {"run_start_year": None, "sequence": "5", "year": 2026, "title": "X"}, COMIC | {"source_id": "t", "run_start_year": None, "sequence": "9", "title": "Y"}])
    runs = spark.createDataFrame([("Absolute Batman", "r1", "comic", 2000, "p"), ("Absolute Batman", "r2", "comic", 2020, "p")], "series_title string, run_id string, provider string, run_start_year int, publisher string")
    issues = table(spark, CANDIDATES, [ISSUE | {"run_id": "r1", "sequence": "5", "cover_date": "2001-01"}, ISSUE | {"run_id": "r2", "sequence": "5", "cover_date": "2026-02"}, ISSUE | {"run_id": "r2", "sequence": "9"}])
    matched = candidates.matching_runs(local, runs)
    assert {r.n for r in matched.collect()} == {2}
    got = {r.source_id: (r.run_id, r.reason) for r in candidates.disambiguate_runs(local, matched, issues, candidates.series_hints(local)).collect()}
    assert got == {"s": ("r2", "cover year"), "t": ("r2", "issue in one run")}
    asked = spark.createDataFrame([("s", "r2", "5")], "source_id string, run_id string, seq string")
    assert candidates.issues_in_runs(asked, issues, runs).first().run_start_year == 2024
    known = spark.createDataFrame([("x", "r9")], "key string, run_id string")
    assert {(r.key, r.run_id) for r in candidates.learned_aliases(issues.where("run_id = 'r2'"), known).collect()} == {("x", "r9"), ("absolute batman", "r2")}


def test_adaptation_and_rejection(spark):
    local = table(spark, LOCAL, [COMIC | {"subtype": "collected-edition", "title": "Book 2", "series_title": "Saga", "sequence": "2"}])
    found = table(spark, CANDIDATES, [EDITION | {"title": "Saga Book Two", "creators": [("Ann Lee", "author"), ("Big Press", "author")]}, EDITION | {"candidate_key": "k2", "title": "Saga #3"}, EDITION | {"candidate_key": "k3", "title": "Saga Book 3"}, EDITION | {"candidate_key": "k4", "title": "Saga"}])
    blocked = local.select("source_id").join(found.select("candidate_key")).withColumn("strategy", F.lit("t"))
    rows = candidates.pairs(local, found, blocked)
    reasons = {r.candidate_key: r.x for r in rows.select("candidate_key", candidates.rejection_reason(F.col("l.sequence.normalized")).alias("x")).collect()}
    assert reasons == {"k1": None, "k2": "issue_shaped_book", "k3": "collection_sequence_conflict", "k4": "collection_sequence_missing"}
    c = candidates.adapt_collections(rows).first().c
    assert (c.record_type, c.sequence.normalized, [x.role for x in c.creators], c.provider_metadata["collection_organization_contributors"], c.provider_metadata["collection_sequence_source"]) == ("comic_collection", "2", ["writer"], "Big Press", "provider_title")


def test_local_identity(spark):
    from tallyweave.functions import names

    df = spark.createDataFrame([("s", "C/Saga #002 (2013).cbz", "cbz", "Ann, Bob", ["978-0140268867", "x"], "77")], "source_id string, path string, format string, writer string, ids array<string>, gtin string")
    rows = names.classify(names.parse_book_names(names.parse_comic_names(df)))
    r = candidates.local_identity(rows, writer="writer", identifiers="ids", gtin="gtin").first()
    assert (r.kind, r.subtype, r.series_title, r.sequence.normalized, r.creators, [tuple(i) for i in r.identifiers]) == ("comic", "issue", "Saga", "2", ["Ann", "Bob"], [("isbn", "9780140268867"), ("gtin", "77")])


def test_classes_search_a_name_once(spark):
    """Each signal is a column that scores and hypotheses share, and the work on names is dealt to tasks whatever the splits of the file."""
    from conftest import SF
    from tallyweave.plans import shapes

    plan = shapes.classified(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("watchmen") == 1 and plan.count("handbook|manual") == 1
    for q in (shapes.classified, shapes.local_identities, shapes.evidence_rows):
        assert "RepartitionByExpression" in q(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
