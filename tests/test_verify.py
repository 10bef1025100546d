"""Archives, reconciliation, rollback and recovery, preflight, reports, quotas."""

from datetime import datetime

from pyspark.sql import functions as F

from tallyweave.operators import candidates, plan, report, verify

MEMBER = "archive_id string, entry_no int, path string, size bigint, compressed_size bigint, is_directory boolean, is_link boolean, is_encrypted boolean, sha256 string"


def members(spark, *rows):
    """(archive, entry, path, size)"""
    return spark.createDataFrame([(a, n, p, s, 1, False, False, False, str(s)) for a, n, p, s in rows], MEMBER)


def test_archive_safety(spark):
    m = members(spark, ("ok", 1, "a/b.jpg", 5), ("case", 1, "Page.jpg", 1), ("case", 2, "page.jpg", 1), ("up", 1, "ok.jpg", 1), ("up", 2, "../x", 1), ("abs", 1, "/x", 1), ("drive", 1, "C:x", 1), ("none", 1, None, 1), ("big", 1, "x", 600 * verify.MIB), ("deep", 1, "/".join("x" * 21), 1), ("ratio", 1, "x", 5000))
    got = {r.archive_id: (r.reason, r.entry_no) for r in verify.archive_safety(m).collect()}
    assert got == {"ok": (None, None), "case": ("duplicate path", 2), "up": ("unsafe path", 2), "abs": ("unsafe path", 1), "drive": ("unsafe path", 1), "none": ("unsafe path", 1), "big": ("entry too large", 1), "deep": ("path too deep", 1), "ratio": ("compression ratio", 1)}
    assert verify.archive_safety(m, max_entries=1).where("archive_id = 'case'").first().reason == "too many entries"
    profile = {r.archive_id: r for r in verify.archive_profile(members(spark, ("a", 1, "x/ComicInfo.xml", 1), ("a", 2, "ComicInfo.xml", 1), ("a", 3, "p.PNG", 1))).collect()}
    assert (profile["a"].entries, profile["a"].pages, profile["a"].info_error) == (3, 1, "several metadata entries")


def test_reconciliation(spark):
    before = members(spark, ("a", 1, "P1.jpg", 1), ("a", 2, "p2.jpg", 2), ("a", 3, "p3.jpg", 3), ("a", 4, "p4.jpg", 4), ("a", 5, "comicinfo.xml", 9))
    after = members(spark, ("a", 1, "p1.jpg", 1), ("a", 3, "p2.jpg", 2), ("a", 2, "p3.jpg", 7), ("a", 5, "p5.jpg", 5))
    got = {r.name: r.status for r in verify.reconcile_members(before, after).collect()}
    assert got == {"p1.jpg": "same", "p2.jpg": "moved", "p3.jpg": "changed", "p4.jpg": "removed", "p5.jpg": "added"}
    assert verify.unowned_lost(before.select("path"), after.select("path")).count() == 3
    assert verify.structure_changes(before.select("path"), before.select("path")).count() == 0


def test_readback(spark):
    e = spark.createDataFrame([("a", "language", "set", "en-GB"), ("a", "date", "set", "2024-05"), ("a", "series_index", "set", "1.0"), ("a", "isbn13", "set", "978-1"), ("a", "title", "set", "T"), ("a", "Number", "clear", None), ("a", "x", "set", "1")], "id string, field string, op string, value string")
    a = spark.createDataFrame([("a", "language", "en"), ("a", "date", "2024-05-09"), ("a", "series_index", "1"), ("a", "isbn13", "9781"), ("a", "title", "U"), ("a", "Number", "4")], "id string, field string, value string")
    assert {r.field: r.problem for r in verify.metadata_readback(e, a, ["id"]).collect()} == {"title": "differs", "Number": "not cleared", "x": "missing"}


def test_multivolume(spark):
    paths = ["comic.part01.rar", "comic.rar", "comic.r00", "other.rar", "x.cbr"]
    got = {r.path for r in verify.multivolume(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"comic.part01.rar", "comic.rar", "comic.r00"}


def items(spark, *rows):
    """(item, state, policy, source, destination, archive, staged)"""
    return spark.createDataFrame([("r", i, st, s, "H", None if g is None else g, "S" if g else None, d, "D", p, a, None) for i, st, p, s, d, a, g in rows], "run_id string, item_id string, state string, source_path string, planned_source_hash string, staging_path string, staged_hash string, destination_path string, destination_hash string, lifecycle_policy string, archive_path string, completed_at timestamp")


def test_rollback_and_recovery(spark):
    inv = spark.createDataFrame([("/s", "H", 1, "zip"), ("/d", "D", 1, "zip"), ("/bad", "X", 1, "zip"), ("/arc", "H", 1, "zip"), ("/g", "S", 1, "zip")], "path string, sha256 string, size bigint, signature string")
    rows = items(spark, ("pending", "pending", "preserve", "/s", "/d", None, None), ("keep", "complete", "preserve", "/s", "/d", None, None), ("changed", "complete", "preserve", "/s", "/bad", None, None), ("gone", "complete", "preserve", "/s", "/no", None, None), ("restore", "complete", "archive_after_verify", "/no", "/d", "/arc", None), ("moved", "complete", "move_after_verify", "/no", "/d", None, None), ("odd", "complete", "preserve", "/no", "/d", None, None))
    got = {r.item_id: r.action for r in verify.rollback_preview(rows, inv).collect()}
    assert got == {"pending": "none", "keep": "remove_unchanged_destination", "changed": "refuse", "gone": "manual", "restore": "restore_archive_then_remove_destination", "moved": "impossible", "odd": "manual"}
    rows = items(spark, ("a", "complete", "x", "/s", "/d", None, None), ("b", "committing", "x", "/s", "/d", None, "/g"), ("c", "verified", "x", "/s", "/no", None, "/g"), ("d", "failed", "x", "/s", "/no", None, None), ("e", "recovery_required", "x", "/s", "/bad", None, None))
    got = {r.item_id: r for r in verify.recovery_inspection(rows, inv).collect()}
    assert [got[k].manual for k in "abcde"] == [False, False, False, False, True] and got["b"].action.startswith("recognize") and got["c"].staging_matches and not got["e"].destination_matches
    runs = spark.createDataFrame([("r", 1)], "id string, plan_id bigint")
    void = verify.recovery_inspection(rows, inv, spark.createDataFrame([(1, "old")], "plan_id bigint, reason string"), runs)
    assert {(r.action, r.manual) for r in void.collect()} == {("none; plan is invalidated (old)", False)}


def test_reset_preflight_and_space(spark):
    inv = spark.createDataFrame([("/d", "D", 5, "zip"), ("/in/taken", "T", 1, "zip"), ("/s", "H", 5, "zip")], "path string, sha256 string, size bigint, signature string")
    now = datetime(2024, 1, 1)
    done = items(spark, ("a", "complete", "x", "/s", "/d", None, None)).withColumn("completed_at", F.lit(now))
    runs = spark.createDataFrame([("r", "complete")], "id string, status string")
    ask = spark.createDataFrame([("/d", "/in/x"), ("/d", "/in/taken"), ("/d", "/out/x"), ("/no", "/in/y")], "destination_path string, target_path string")
    roots = spark.createDataFrame([("/in/",)], "root string")
    got = {(r.destination_path, r.target_path): r.reason for r in verify.reset_eligibility(ask, done, runs, inv, roots).collect()}
    assert got == {("/d", "/in/x"): None, ("/d", "/in/taken"): "target exists", ("/d", "/out/x"): "target is outside the incoming roots", ("/no", "/in/y"): "destination is not a file"}
    planned = spark.createDataFrame([("1", "/s", "H", 5, "zip", "/lib/a.cbz", "a.cbz", "/lib", None, 1, "cbz"), ("2", "/s", "X", 6, "rar", "/d", "d", "/lib", "/d", 2, "cbz")], "item_id string, source_path string, planned_source_hash string, size bigint, signature string, destination_path string, relative_path string, root string, archive_path string, device bigint, format string")
    capacity = spark.createDataFrame([(1, 1 << 40), (2, 5)], "device bigint, free bigint")
    got = {r.item_id: set(r.problems) for r in verify.preflight(planned, inv, capacity).collect()}
    assert got["1"] == set() and got["2"] == {"size changed", "hash changed", "signature mismatch", "destination exists", "archive exists", "destination outside its root", "not enough space"}


def test_completed_and_stale_sources(spark):
    inv = spark.createDataFrame([("/d1", "D"), ("/d2", "X")], "path string, sha256 string")
    scan = spark.createDataFrame([(f"/s{i}", "H") for i in range(1, 5)], "path string, sha256 string")
    done = spark.createDataFrame([("r", "complete", f"/s{i}", "H", f"/d{i}", "D", datetime(2024, 1, 1)) for i in (1, 2, 3)], "run_id string, state string, source_path string, planned_source_hash string, destination_path string, destination_hash string, completed_at timestamp")
    runs = spark.createDataFrame([("r", "complete")], "id string, status string")
    assert {r.path: r.status for r in plan.completed_sources(scan, done, runs, inv).collect()} == {"/s1": "completed", "/s2": "destination_mismatch", "/s3": "destination_missing", "/s4": "current"}
    kind = "path string, sha256 string, size bigint, format string, signature string"
    old = spark.createDataFrame([("a", "1", 1, "f", "s"), ("b", "1", 1, "f", "s"), ("c", "1", 1, "f", None)], kind)
    new = spark.createDataFrame([("a", "1", 1, "f", "s"), ("b", "2", 1, "f", "s")], kind)
    assert {r.path: r.source_state for r in plan.stale_sources(old, new).collect()} == {"a": "same", "b": "stale", "c": "missing"}
    sources = spark.createDataFrame([(1, "/x/a"), (2, "/x/b"), (3, "/y/a")], "id bigint, path string")
    kinds = spark.createDataFrame([(1, 1, "book", "s"), (2, 1, "comic", "s"), (3, 2, "comic", "s")], "id bigint, source_id bigint, kind string, subtype string")
    seen = spark.createDataFrame([(1, 1, "ok", "{}"), (2, 2, "ok", "{}"), (3, 2, "failed", "{}")], "id bigint, source_id bigint, status string, metadata_json string")
    assert [(r.id, r.kind) for r in plan.reviewed_sources(sources, kinds, seen, "/x/").collect()] == [(1, "comic")]


def test_rolling_quota(spark):
    t = 1_000.0
    policies = spark.createDataFrame([("p", "b", 2, 100.0, 10.0)], "provider string, bucket string, max_requests int, window_seconds double, min_interval double")
    log = spark.createDataFrame([("p", "b", t), ("p", "b", t + 10)], "provider string, bucket string, reserved_at double")
    blocks = spark.createDataFrame([("p", "b", t + 270.0), ("p", "b", t + 215.0)], "provider string, bucket string, blocked_until double")
    none = blocks.limit(0)
    probe = lambda *at: spark.createDataFrame([("p", "b", x) for x in at], "provider string, bucket string, at double")
    got = {r["at"]: r["wait"] for r in report.quota_probes(probe(t, t + 10, t + 100, t + 150), log, none, policies).collect()}
    assert got == {t: 10.0, t + 10: 90.0, t + 100: 0.0, t + 150: 0.0}
    assert report.quota_probes(probe(t + 210), log, blocks, policies).first().wait == 60.0


def test_rolling_quota_of_shared_instants(spark):
    """Probes of one instant do not multiply what they see, and each keeps its row; against brute force."""
    policies = spark.createDataFrame([("p", "b", 4, 100.0, 2.0), ("q", "b", 1, 7.0, 0.0)], "provider string, bucket string, max_requests int, window_seconds double, min_interval double")
    rule = {"p": (4, 100.0, 2.0), "q": (1, 7.0, 0.0)}
    log = [("pq"[i % 2], "b", float(i * 37 % 450 - 50)) for i in range(120)] + [("p", "b", 60.0)] * 3 + [("p", "b", None)]
    probes = [(i, "pq"[i % 2], "b", float(i * 53 % 600)) for i in range(90)] + [(100 + i, "p", "b", 160.0) for i in range(3)] + [(110, "q", "b", None), (111, "p", "b", -900.0)]
    none = spark.createDataFrame([], "provider string, bucket string, blocked_until double")
    got = report.quota_probes(spark.createDataFrame(probes, "id int, provider string, bucket string, at double"), spark.createDataFrame(log, "provider string, bucket string, reserved_at double"), none, policies)

    def want(provider, at):
        most, width, gap = rule[provider]
        seen = [r for p, _, r in log if p == provider and r is not None and at is not None and at - width < r <= at]
        wait = max([0.0] + ([max(seen) + gap - at] if seen else []) + ([min(seen) + width - at] if len(seen) >= most else []))
        return len(seen), wait, wait <= 0

    assert {r.id: (r.in_window, r.wait, r.allowed) for r in got.collect()} == {i: want(p, at) for i, p, _, at in probes} and got.count() == len(probes)


def test_reports(spark):
    audit = spark.createDataFrame([("a", True, True, False, [], 1, 0, "accepted", "unresolved", "issue"), ("b", False, None, None, None, 0, 1, None, None, "collected-edition"), ("c", True, False, True, ["collected edition cannot resolve to a regular issue"], 1, 1, None, None, "collected-edition")], "id string, has_candidate boolean, eligible boolean, hard_contradiction boolean, contradictions array<string>, available int, unavailable int, work_state string, edition_state string, subtype string")
    r = report.match_summary(audit).first().asDict()
    assert (r["sources"], r["candidate_found"], r["no_candidate"], r["eligible_high_confidence"], r["review_required"], r["provider_unavailable"], r["partial_provider_unavailable"], r["collected_as_issue_contradictions"], r["work_accepted_edition_unresolved"]) == (3, 2, 1, 1, 1, 1, 1, 1, 1) and len(r) == 14
    prepared = spark.createDataFrame([(1, "/l", "cbr", 100, 10, 2, 0, "preserve"), (1, "/m", "cbz", 100, None, 0, 1, "preserve")], "plan_id bigint, root string, format string, size bigint, inventory_size bigint, set_fields int, conflicts int, lifecycle_policy string")
    r = report.apply_preview(prepared).first()
    assert (r["items"], r.libraries, r.writes, r.conversions, r.lifecycles, r.conflicts, r.bytes) == (2, ["/l", "/m"], 1, 1, {"preserve": 2}, 1, 2 * 64 * verify.MIB)
    scope = report.common_scope(spark.createDataFrame([("/a/b/x",), ("/a/bc/y",)], "path string")).first()
    assert (scope.scope, scope.n) == ("/a", 2) and report.common_scope(spark.createDataFrame([], "path string")).count() == 0
    runs = spark.createDataFrame([("r1", 1, "d", "failed", datetime(2024, 1, 1)), ("r2", 2, "d", "running", datetime(2024, 1, 1))], "id string, plan_id bigint, plan_digest string, status string, started_at timestamp")
    its = spark.createDataFrame([("r1", "i", "failed"), ("r2", "i", "committing"), ("r2", "j", "stale")], "run_id string, item_id string, state string")
    plans = spark.createDataFrame([(1, "d"), (2, "d")], "id bigint, sha256 string")
    assert {r.plan_id: (r.abandonable, r.unsafe) for r in report.abandonable(runs, its, plans).collect()} == {1: (True, []), 2: (False, ["i=committing"])}
    log = spark.createDataFrame([("p", 100.0), ("p", 5000.0)], "provider string, reserved_at double")
    assert tuple(report.attention(runs, its, log, 5001.0).first()) == (1, 1, 1)
    assert {r.status for r in report.run_rollup(its).collect()} == {"recovery_required"}


def test_sets_attempts_and_hints(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    one = rows.where("k = 'a'")
    assert report.in_scope(rows, one, "k").count() == 1 and report.out_of_scope(rows, one, "k").first().k == "b"
    merged = candidates.union_results(spark.createDataFrame([("k", "old")], "candidate_key string, t string"), spark.createDataFrame([("k", "new"), ("m", "x")], "candidate_key string, t string"))
    assert {(r.candidate_key, r.t) for r in merged.collect()} == {("k", "new"), ("m", "x")}
    blocked = spark.createDataFrame([("s", "k", "p", "vol"), ("s", "m", "p", "vol")], "source_id string, candidate_key string, provider string, strategy string")
    reasons = spark.createDataFrame([("s", "m", "wrong_record_type")], "source_id string, candidate_key string, reason string")
    r = candidates.attempts(blocked, reasons).first()
    assert (r.raw, r.accepted, r.rejected) == (2, 1, {"wrong_record_type": 1})
    local = spark.createDataFrame([("s", "collected-edition", "Saga", [])], "source_id string, subtype string, series_title string, creators array<string>")
    said = spark.createDataFrame([(2, "comic:saga", "B"), (1, "comic:saga", "A")], "id bigint, group_key string, writer string")
    assert candidates.with_writer_hints(local, said).first().creator_hint == "A"
    runs = spark.createDataFrame([("Saga", "r1", 2012), ("Saga", "r2", None)], "series_title string, run_id string, run_start_year int")
    carried = spark.createDataFrame([("comic:saga", "r1", "Saga", 2012), ("comic:saga", "r3", "Saga II", 2020)], "group_key string, run_id string, series_title string, run_start_year int")
    groups = spark.createDataFrame([("comic:saga",)], "group_key string")
    assert [r.run_id for r in candidates.run_choices(groups, runs, carried).collect()] == ["r1", "r3"]


def test_quota_counts_in_two_levels(spark):
    """Against every pair, with ties, empty slots, one crowded provider, nulls in time and key."""
    import random

    from tallyweave.operators import report

    rng = random.Random(6)
    rows = [("p" if rng.random() < 0.7 else rng.choice(["q", None]), "x", rng.choice([rng.randrange(100_000), rng.randrange(500), 7]) / 10) for _ in range(400)] + [("p", "x", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, provider string, bucket string, s double").withColumn("reserved_at", F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long"))).repartition(6)
    for window, slots in ((60, 16), (60, 1), (1, 16), (100_000, 3)):
        for r in report.quota_log_audit(df, window, slots=slots).collect():
            if r.s is None:
                assert (r.in_window, r.gap, r.at_once) == (None, None, None) or r.in_window is None
                continue
            mine = [x for x in rows if x[0] == r.provider and x[2] is not None]
            assert r.in_window == sum(round(r.s * 1e6) - window * 1e6 < round(x[2] * 1e6) <= round(r.s * 1e6) for x in mine), (window, slots, r)
            before = [x[2] for x in mine if x[2] < r.s]
            assert (r.gap is None) == (not before) and (not before or abs(r.gap - (r.s - max(before))) < 1e-6)
            assert r.at_once == sum(x[2] == r.s for x in mine)
    assert report.quota_log_audit(df.limit(0), 60).count() == 0
