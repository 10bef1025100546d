"""Histories, golden records, projection, plans."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from tallyweave.functions.sequence import sequence_struct
from tallyweave.operators import golden, history, numbering, plan, project
from tallyweave.schemas import CANDIDATES, DECISIONS
from test_linkage import ISSUE, table

T0 = datetime(2024, 1, 1)


def decisions(spark, *rows):
    """(id, fingerprint, type, payload)"""
    return spark.createDataFrame([(i, f, "cbz:1", t, "k", "e", "d", p, T0, None, None) for i, f, t, p in rows], DECISIONS)


def test_latest_chain_and_authority(spark):
    d = decisions(spark, (1, "a", "accepted", "{}"), (2, "a", "unresolved", "{}"), (3, "b", "accepted", "{}"), (4, "b", "manual_override", "{}"))
    assert {(r.source_fingerprint, r.id) for r in history.latest(d, history.KEY).collect()} == {("a", 2), ("b", 4)}
    assert {(r.id, r.supersedes_id) for r in history.with_supersedes(d, history.KEY).collect()} == {(1, None), (2, 1), (3, None), (4, 3)}
    assert [(r.source_fingerprint, r.id) for r in history.authorising(d).collect()] == [("b", 3)]


def test_override_fold(spark):
    d = decisions(spark, (1, "a", "manual_override", '{"overrides":{"title":"A","publisher":"P"}}'), (2, "a", "manual_override", '{"cleared_fields":["publisher"]}'), (3, "a", "manual_override", '{"overrides":{"title":"B"}}'))
    want = {("title", "B")}
    assert {(r.field, r.value) for r in history.override_fold(d).collect()} == want
    assert {(r.field, r.value) for r in history.override_fold(d.repartition(3).orderBy(F.desc("id"))).collect()} == want


def test_appending(spark):
    old = decisions(spark, (7, "a", "accepted", "{}"))
    new = spark.createDataFrame([("a", "cbz:1", "accepted", "k", "e", "d", "{}", T0, None, "book_work"), ("a", "cbz:1", "accepted", "k", "e", "d", "{}", T0, None, "comic_run"), ("b", "cbz:1", "manual_identity", None, "e", None, '{"identity":{"title":""}}', T0, None, None), ("c", "cbz:1", "manual_override", None, "e", None, '{"cleared_fields":["title"]}', T0, None, None)], "source_fingerprint string, media_signature string, decision_type string, candidate_key string, source_evidence_hash string, candidate_data_hash string, payload_json string, created_at timestamp, batch_id string, record_type string")
    good, bad = history.append_decisions(old, new)
    assert [(r.id, r.decision_type, r.supersedes_id) for r in good.collect()] == [(8, "work_accepted", 7)]
    assert bad.count() == 3
    choices = spark.createDataFrame([(1, "comic:x", "comic", "selected", "r1", "{}", T0, None)], "id bigint, group_key string, provider string, decision_type string, provider_run_id string, run_snapshot_json string, created_at timestamp, supersedes_id bigint")
    ask = spark.createDataFrame([("comic:x", "comic", "cleared", None, "{}", T0), ("comic:y", "comic", "cleared", None, "{}", T0), ("comic:x", "comic", "selected", "", "{}", T0)], "group_key string, provider string, decision_type string, provider_run_id string, run_snapshot_json string, created_at timestamp")
    good, bad = history.append_run_choices(choices, ask)
    assert [(r.id, r.supersedes_id) for r in good.collect()] == [(2, 1)] and bad.count() == 2
    assert history.active_choices(choices.unionByName(good)).count() == 0


def test_suppression_and_review(spark):
    d = decisions(spark, (1, "a", "rejected", "{}"), (2, "b", "unresolved", '{"reason":"review_reopened"}'), (3, "c", "accepted", "{}"))
    scores = spark.createDataFrame([("a", "cbz:1", "k", "e", "d", True), ("c", "cbz:1", "k", "e", "d", True)], "source_fingerprint string, media_signature string, candidate_key string, source_evidence_hash string, candidate_data_hash string, eligible boolean")
    assert {(r.source_fingerprint, r.suppressed, r.eligible) for r in history.suppress_rejected(scores, d).collect()} == {("a", True, False), ("c", False, True)}
    sources = spark.createDataFrame([(x, "cbz:1", h) for x, h in (("a", "e"), ("b", "e"), ("c", "other"), ("z", "e"))], "source_fingerprint string, media_signature string, evidence_hash string")
    assert {r.source_fingerprint: r.needs_review for r in history.needs_review(sources, d).collect()} == {"a": False, "b": True, "c": True, "z": True}
    base = spark.createDataFrame([("a", 1)], "source_fingerprint string, baseline_id bigint")
    assert history.needs_review(sources, d, base).where("source_fingerprint = 'a'").first().needs_review


def test_plans_in_time(spark):
    items = spark.createDataFrame([(1, "i1", "a"), (2, "i2", "a"), (3, "i3", "b")], "plan_id bigint, item_id string, source_fingerprint string")
    runs = spark.createDataFrame([("r", 2, "complete", T0)], "id string, plan_id bigint, status string, started_at timestamp")
    assert [(r.old_plan_id, r.new_plan_id) for r in history.supersessions(items, 2, runs).collect()] == [(1, 2)]
    assert [(r.old_plan_id, r.new_plan_id) for r in history.all_supersessions(items, runs).collect()] == [(1, 2)]
    pre = spark.createDataFrame([(1, "i1", "a", 1, None, None), (3, "i3", "b", 5, "comic:x", 1)], "plan_id bigint, item_id string, source_fingerprint string, decision_head_id bigint, run_group_key string, run_group_decision_id bigint")
    d = decisions(spark, (1, "a", "accepted", "{}"), (2, "a", "rejected", "{}"), (5, "b", "accepted", "{}"))
    choices = spark.createDataFrame([(1, "comic:x"), (2, "comic:x")], "id bigint, group_key string")
    assert {r.plan_id for r in history.invalidations(pre, d, choices).collect()} == {1, 3}
    assert [r.plan_id for r in history.stale_preconditions(pre, d).collect()] == [1]
    plans = spark.createDataFrame([(1, "draft"), (2, "approved"), (3, "draft")], "id bigint, status string")
    none = spark.createDataFrame([], "plan_id bigint, reason string")
    old = spark.createDataFrame([(1, 2)], "old_plan_id bigint, new_plan_id bigint")
    active = history.active_plans(plans, none, old, runs)
    assert [r.id for r in active.collect()] == [3]
    invalid = spark.createDataFrame([(1, "x"), (3, "x")], "plan_id bigint, reason string")
    states = spark.createDataFrame([("r", "i2", "complete")], "run_id string, item_id string, state string")
    assert {r.plan_id: r.replaced for r in history.replaced_invalidations(invalid, items, runs, states).collect()} == {1: True, 3: False}
    sources = spark.createDataFrame([("/x/a", "a", "cbz", 1), ("/x/b", "b", "cbz", 1)], "path string, sha256 string, format string, size bigint")
    assert [r.path for r in history.reviewed_without_plan(sources, d, pre, runs).collect()] == ["/x/b"]
    empty = sources.limit(0).select("path")
    assert history.resume_state(runs.limit(0), active, empty, empty).first().state == "draft"
    assert history.resume_state(runs.limit(0), active.limit(0), sources.select("path"), empty).first()["count"] == 2


def test_incompatible_with_run(spark):
    d = decisions(spark, (1, "a", "accepted", '{"candidate":{"run_id":"r1"}}'), (2, "b", "accepted", '{"candidate":{"run_id":"r2"}}'))
    sources = spark.createDataFrame([("a", "cbz:1", "comic:x", "e"), ("b", "cbz:1", "comic:x", "e")], "source_fingerprint string, media_signature string, group_key string, evidence_hash string")
    choices = spark.createDataFrame([("comic:x", "r2")], "group_key string, chosen_run string")
    assert [r.source_fingerprint for r in history.incompatible_with_run(sources, d, choices).collect()] == ["a"]


def test_hydration(spark):
    found = table(spark, CANDIDATES, [ISSUE | {"creators": [("Ann", "writer")], "provider_metadata": {"a": "1", "b": "2"}}])
    detail = table(spark, CANDIDATES, [ISSUE | {"publisher": "P", "creators": [("ann", "Writer"), ("Bob", "inker")], "provider_metadata": {"b": "3"}, "release_date": "2026-01-02"}])
    r = golden.hydrate(found, detail).first()
    assert (r.status, r.publisher, len(r.creators), r.provider_metadata) == ("hydrated", "P", 2, {"a": "1", "b": "3"}) and set(r.changes) == {"contributors", "publisher", "release_date"}
    r = golden.hydrate(found, detail.withColumn("run_start_year", F.lit(1999))).first()
    assert r.status == "conflict" and r.publisher is None and "run start year differs" in r.conflicts[0]
    assert golden.hydrate(found, detail.limit(0)).first().status == "not_found"


def test_golden_records(spark):
    payload = '{"candidate": {"candidate_key": "k", "provider": "comic", "provider_id": "1", "record_type": "comic_issue", "media_kind": "comic", "title": "Saga", "series_title": "Saga", "item_type": "issue", "run_start_year": 2012, "creators": [{"name": "Ann", "role": "writer"}, {"name": "Bob", "role": "odd"}], "identifiers": [{"scheme": "isbn", "value": "1"}], "publisher": "P"}, "local_presentation": {"title": "The Zoo", "series_title": "Saga", "subtype": "issue"}}'
    manual = '{"identity": {"title": "T", "authors": "A, B", "isbn": "9"}}'
    d = decisions(spark, (1, "a", "accepted", payload), (2, "a", "manual_override", '{"overrides":{"sequence":"07","publisher":"Q"}}'), (3, "b", "manual_identity", manual), (4, "c", "skipped", "{}"), (5, "e", "work_accepted", payload))
    sources = spark.createDataFrame([("a", "cbz:1", "comic"), ("b", "cbz:1", "book"), ("c", "cbz:1", "book"), ("d", "cbz:1", "book"), ("e", "cbz:1", "comic")], "source_fingerprint string, media_signature string, media_kind string")
    kind = spark.createDataFrame([], CANDIDATES).schema.simpleString()
    got = {r.source_fingerprint: r for r in golden.resolve_sources(sources, d, kind).collect()}
    a = got["a"]
    assert (a.title, a.sequence.normalized, a.publisher, a.creators, a.contributors["unknown:odd"], a.eligible) == ("The Zoo", "7", "Q", ["Ann"], ["Bob"], True)
    assert (got["b"].creators, got["b"].identifiers, got["b"].resolution, got["b"].eligible) == (["A", "B"], {"isbn": "9"}, "manual", True)
    assert got["c"].error == "latest explicit decision is skipped" and got["d"].error == "no explicit identity decision exists"
    assert got["e"].publisher is None and got["e"].resolution == "work_only" and "comic issue sequence is unresolved" in got["e"].blocks


def test_override_validation(spark):
    rows = [("isbn", "978-0140268867", True, "9780140268867"), ("isbn", "1", False, None), ("sequence", "007", True, "7"), ("run_start_year", "1700", False, None), ("run_start_year", "2027", True, "2027"), ("collection_volume", "0", False, None), ("date", "2024-02-30", False, None), ("date", "2024-02-29", True, "2024-02-29"), ("language", "en-GB", True, "en-GB"), ("language", "e", False, None), ("item_type", "Issue", True, "issue"), ("authors", " , ", False, None), ("authors", "A, B", True, "A,B"), ("title", " ", False, None), ("other", "x", False, None), (None, None, False, None)]
    df = spark.createDataFrame(rows, "field string, value string, want boolean, standard string")
    assert all((r.valid, r.resolved) == (r.want, r.standard) and (r.error is None) == r.valid or r.field is None for r in golden.validate_overrides(df, 2026).collect())


def comic(spark, **fields):
    base = {"media_kind": "comic", "title": "The Zoo", "creators": ["Ann"], "series_title": "Absolute Batman", "run_start_year": 2024, "item_type": "issue", "collection_volume": None, "publisher": None, "release_date": "2026-01-07", "release_date_precision": "day", "language": "en", "contributors": {"writers": ["Ann", "Bob"]}, "identifiers": {}, "seq": "0.5"} | fields
    ddl = "media_kind string, title string, creators array<string>, series_title string, run_start_year int, item_type string, collection_volume int, publisher string, release_date string, release_date_precision string, language string, contributors map<string, array<string>>, identifiers map<string, string>, seq string"
    return spark.createDataFrame([tuple(base.values())], ddl).withColumn("sequence", sequence_struct(F.col("seq"))).withColumn("id", F.lit(1))


def test_projection(spark):
    r = project.project_comics(comic(spark, title=""), ["id"]).first()
    assert r.destination == "Absolute Batman (2024)/Absolute Batman (2024) - 0.5.cbz"
    r = project.project_comics(comic(spark), ["id"]).first()
    assert r.metadata["Writer"] == "Ann, Bob" and r.metadata["Day"] == "7" and r.ownership.clear == ["Volume", "Format"] and "Year" not in r.ownership.preserve
    r = project.project_comics(comic(spark, item_type="omnibus", collection_volume=2, release_date_precision="month"), ["id"]).first()
    assert r.destination == "Absolute Batman (2024)/Specials/Absolute Batman (2024) - v02 - The Zoo.cbz" and "Number" in r.ownership.clear and "Year" in r.ownership.preserve
    assert project.project_comics(comic(spark, run_start_year=None), ["id"]).first().error == "comic run start year is unresolved"
    assert project.project_comics(comic(spark, media_kind="book"), ["id"]).first().destination is None
    r = project.project_comic_pdfs(comic(spark), ["id"]).first()
    assert r.filename.endswith(".pdf") and r.metadata["series"] == "Absolute Batman (2024)" and r.ownership.preserve == ["series_index"]
    ok = project.project_comics(comic(spark), ["id"]).select(project.check_ownership(F.col("ownership")).alias("x")).first().x
    assert ok


def test_templates():
    import pytest

    for bad in ("", "{nope}", "a/b", "{title!r}", "{title:>3}"):
        with pytest.raises(ValueError):
            project.check_template(bad)
    with pytest.raises(ValueError):
        project.NamingPolicy(integer_padding=0)


def test_plan_gates(spark):
    good = '{"schema_version":3,"planning_policy":{"version":"2"},"permissions":{"file_mode":"0644","directory_mode":"0755"},"items":[{"item_id":"i","source":{"path":"/a/x.cbz","signature":"zip"},"projection":{"destination":"d"},"provenance":{"explicit_approval":true,"acceptance":{"low_confidence_override":true,"score":50.0}},"planning_policy":{"version":"2"}}]}'
    rows = [(1, good), (2, good.replace("0644", "0666")), (3, good.replace('"zip"', '"exe"')), (4, "{nope"), (5, good.replace("true,", "false,", 1)), (6, good.replace('"schema_version":3', '"schema_version":9'))]
    plans = spark.createDataFrame(rows, "id bigint, canonical_json string").withColumn("sha256", F.sha2("canonical_json", 256)).withColumn("status", F.lit("approved")).withColumn("approval_digest", F.col("sha256"))
    got = {r.id: r.reasons for r in plan.validate_plans(plans).collect()}
    assert got[1] == [] and got[2] == ["unsafe permission modes"] and got[3] == ["unsupported source signature"] and "invalid JSON" in got[4] and got[5] and "unsupported schema version" in got[6]
    assert [(r.source, r.score) for r in plan.acceptance_risks(plan.validate_plans(plans).where("id = 1")).collect()] == [("x.cbz", 50.0)]
    none = spark.createDataFrame([], "plan_id bigint, old_plan_id bigint")
    refused = {r.id: r.refusals for r in plan.eligible_plans(plan.validate_plans(plans), none, none, plans.where("id = 1").select(F.col("id").alias("plan_id"))).collect()}
    assert refused[1] == ["stale precondition"]


def test_numbering_is_the_order_of_all_rows(spark):
    rows = [(i * 7919 % 1000, None if i % 50 == 0 else f"k{i % 13}", i) for i in range(2000)] + [(5, "k1", i) for i in range(2000, 2600)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    got = {r.c: r.place for r in numbering.numbered(df, ["a", "b", "c"], "place").collect()}
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    assert got == {r[2]: i for i, r in enumerate(want, 1)}
    assert numbering.numbered(df.where("a < 0"), ["a"], "place").count() == 0
    tied = numbering.numbered(spark.createDataFrame([(1,)] * 5, "a int"), ["a"], "place")
    assert sorted(r.place for r in tied.collect()) == [1, 2, 3, 4, 5]


def test_numbering_spreads_ties_and_cuts_finely(spark, monkeypatch):
    """A key that most rows share, with many cuts and with few: places agree and depend on the rows alone."""
    rows = [(7, f"r{i}") for i in range(900)] + [(i, f"s{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "a int, name string")
    one = {r.name: r.place for r in numbering.numbered(df, ["a"], "place").collect()}
    assert sorted(one.values()) == list(range(1, 1201))
    of = dict((n, a) for a, n in rows)
    assert all(of[x] <= of[y] for x, y in zip(sorted(one, key=one.get), sorted(one, key=one.get)[1:], strict=False))
    monkeypatch.setattr(numbering, "CUTS", 130)
    assert {r.name: r.place for r in numbering.numbered(df.repartition(5), ["a"], "place").collect()} == one


def test_numbering_costs_a_row_little(spark):
    """A row is told apart by a few comparisons and does not carry all cuts: 20,000 rows of one task took some 15 s when it did."""
    rows = spark.range(20000, numPartitions=1).select("id", F.concat(F.lit("k"), F.col("id") * 7919 % 20011).alias("a"), F.col("id").cast("string").alias("b"))
    numbering.numbered(rows.limit(10), ["a", "b"], "place").collect()
    began = time.perf_counter()
    assert numbering.numbered(rows, ["a", "b"], "place").agg(F.sum("place")).first()[0] == 20000 * 20001 // 2
    assert time.perf_counter() - began < 8
