"""Rollups, counters, scopes and the request-quota audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.operators.history import KEY

RECOVERABLE = ("recovery_required", "failed", "committing", "committed", "cleanup_pending")
SAFE = ("pending", "preflight_ok", "failed", "stale", "complete")


def _n(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def match_summary(items: DataFrame) -> DataFrame:
    """One row of 14 counters over audited sources.

    ``items`` has one row per source: has_candidate, eligible, hard_contradiction, contradictions, available, unavailable (numbers of
    feeds), work_state, edition_state and subtype.
    """
    found, collected = F.col("has_candidate"), F.col("subtype") == "collected-edition"
    as_issue = F.exists("contradictions", lambda x: x.contains("collected edition cannot"))
    return items.agg(
        F.count("*").alias("sources"), _n(found).alias("candidate_found"), _n(~found).alias("no_candidate"), _n(found & F.col("eligible")).alias("eligible_high_confidence"), _n(found & ~F.coalesce("eligible", F.lit(False))).alias("review_required"), _n(~found).alias("unresolved"),
        _n(F.col("available") > 0).alias("appropriate_provider_available"), _n(~found & (F.col("available") > 0)).alias("no_candidate_despite_provider_available"), _n(F.col("available") == 0).alias("provider_unavailable"), _n((F.col("available") > 0) & (F.col("unavailable") > 0)).alias("partial_provider_unavailable"),
        _n((F.col("work_state") == "accepted") & (F.col("edition_state") == "unresolved")).alias("work_accepted_edition_unresolved"), _n(found & F.col("hard_contradiction")).alias("hard_contradictions"), _n(collected).alias("collected_editions"), _n(collected & found & as_issue).alias("collected_as_issue_contradictions"),
    )


def run_rollup(items: DataFrame) -> DataFrame:
    """(run_id, status): complete if all items are, recovery_required if one is in an open state, else failed."""
    got = items.groupBy("run_id").agg(F.bool_and(F.col("state") == "complete").alias("all_done"), F.bool_or(F.col("state").isin(*RECOVERABLE)).alias("some_open"))
    return got.select("run_id", F.when(F.col("all_done"), "complete").when(F.col("some_open"), "recovery_required").otherwise("failed").alias("status"))


def state_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("run_id", "state").agg(F.count("*").alias("n"))


def apply_preview(items: DataFrame) -> DataFrame:
    """(plan_id, items, libraries, writes, conversions, lifecycles, conflicts, bytes) of prepared items."""
    from tallyweave.operators.verify import estimated_space

    policies = items.groupBy("plan_id", "lifecycle_policy").agg(F.count("*").alias("n")).groupBy("plan_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lifecycle_policy", "n")))).alias("lifecycles"))
    got = items.groupBy("plan_id").agg(
        F.count("*").alias("items"), F.array_sort(F.collect_set("root")).alias("libraries"), _n(F.col("set_fields") > 0).alias("writes"), _n(F.col("format") == "cbr").alias("conversions"), F.sum("conflicts").alias("conflicts"),
        F.sum(estimated_space(F.col("format"), F.col("size"), F.coalesce("inventory_size", F.lit(0)))).alias("bytes"),
    )
    return got.join(policies, "plan_id")


def outputs_per_folder(items: DataFrame, column: str = "destination_path") -> DataFrame:
    """(folder, n); paths without a folder count under a dot."""
    folder = F.when(F.col(column).contains("/"), F.regexp_replace(column, "/[^/]*$", "")).otherwise(F.lit("."))
    return items.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))


OUTCOMES = {"accepted": "accepted", "work_accepted": "work_only", "manual_identity": "manual", "rejected": "rejected", "unresolved": "unresolved", "skipped": "skipped"}


def review_outcomes(reviewed: DataFrame) -> DataFrame:
    """(outcome, n) over rows of ``history.needs_review``; those that still need review have no decision."""
    names = F.create_map(*(F.lit(x) for kv in OUTCOMES.items() for x in kv))
    outcome = F.when(F.col("needs_review"), "no_decision").otherwise(F.coalesce(F.try_element_at(names, F.col("head_type")), F.lit("no_decision")))
    return reviewed.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, df in tables.items()])


def cache_freshness(cache: DataFrame, now: float) -> DataFrame:
    """(provider, total, expired): an entry is expired from its time on."""
    return cache.groupBy("provider").agg(F.count("*").alias("total"), F.count_if(F.col("expires_at") <= now).alias("expired"))


def reviewed_count(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count_distinct(*KEY).alias("reviewed"))


def common_scope(paths: DataFrame, path: str = "path") -> DataFrame:
    """(scope, n): the longest folder that all paths share. The first and last path in order have all that is common."""
    parts = lambda c: F.split(F.regexp_replace(c, "/[^/]*$", ""), "/")
    ends = paths.agg(F.min(path).alias("a"), F.max(path).alias("b"), F.count("*").alias("n")).where("n > 0")
    pairs = F.zip_with(parts(F.col("a")), parts(F.col("b")), lambda x, y: x.eqNullSafe(y))
    length = F.array_position(F.concat(pairs, F.array(F.lit(False))), F.lit(False)) - 1
    return ends.select(F.array_join(F.slice(parts(F.col("a")), F.lit(1), length.cast("int")), "/").alias("scope"), "n")


def in_scope(rows: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the scope."""
    return rows.join(scope.select(key), key, "left_semi")


def out_of_scope(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not excluded."""
    return rows.join(excluded.select(key), key, "left_anti")


def plan_list(plans: DataFrame, plan_items: DataFrame, invalid: DataFrame, superseded: DataFrame) -> DataFrame:
    """(id, status, items, invalidated, superseded) of each plan."""
    items = plan_items.groupBy(F.col("plan_id").alias("id")).agg(F.count("*").alias("items"))
    flag = lambda df, column, name: df.groupBy(F.col(column).alias("id")).agg(F.lit(True).alias(name))
    met = plans.select("id", "status").join(items, "id", "left").join(flag(invalid, "plan_id", "invalidated"), "id", "left").join(flag(superseded, "old_plan_id", "superseded"), "id", "left")
    return met.select("id", "status", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("invalidated", F.lit(False)).alias("invalidated"), F.coalesce("superseded", F.lit(False)).alias("superseded"))


def attention(apply_runs: DataFrame, apply_items: DataFrame, requests: DataFrame, now: float) -> DataFrame:
    """(active_runs, open_items, recent_requests): what waits, and requests of the last hour."""
    active = apply_runs.where(F.col("status").isin("preflighting", "running", "recovery_required"))
    open_items = apply_items.join(active.select(F.col("id").alias("run_id")), "run_id", "left_semi").where(~F.col("state").isin("complete", "stale"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(active, "active_runs").join(one(open_items, "open_items")).join(one(requests.where(F.col("reserved_at") > now - 3600), "recent_requests"))


def abandonable(apply_runs: DataFrame, apply_items: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, run_id, abandonable, unsafe): for each plan's latest run; unsafe items are listed."""
    last = apply_runs.groupBy("plan_id").agg(F.max_by(F.struct("id", "plan_digest", "status"), F.struct("started_at", "id")).alias("r"))
    unsafe = apply_items.where(~F.col("state").isin(*SAFE)).groupBy("run_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "item_id", "state"))).alias("unsafe"))
    met = last.select("plan_id", F.col("r.id").alias("run_id"), F.col("r.plan_digest").alias("digest"), F.col("r.status").alias("status")).join(unsafe, "run_id", "left").join(plans.select(F.col("id").alias("plan_id"), "sha256"), "plan_id")
    unsafe_items = F.coalesce("unsafe", F.array().cast("array<string>"))
    return met.select("plan_id", "run_id", ((F.col("status") != "complete") & F.col("digest").eqNullSafe(F.col("sha256")) & (F.size(unsafe_items) == 0)).alias("abandonable"), unsafe_items.alias("unsafe"))


#: Slots that a window is cut into.
SLOTS = 16


def quota_probes(probes: DataFrame, log: DataFrame, blocks: DataFrame, policies: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``probes`` (provider, bucket, at) with ``in_window``, ``wait`` and ``allowed`` against the log of granted requests.

    A probe sees the requests of its last window (strictly later than its start, up to now). It waits for a block to end, for the least
    gap since the last request, and, with the window full, for the oldest to leave it. ``policies`` (provider, bucket, max_requests,
    window_seconds, min_interval) is short. Blocks only lengthen: the largest end counts. Probes and requests of one instant are one; as in
    ``quota_log_audit``, counts are differences of running totals in two levels, so no probe meets the requests of its window.
    """
    key = ["provider", "bucket"]
    rules = F.broadcast(policies)
    by = [*key, "window_seconds"]
    windows = F.broadcast(policies.select(*by).distinct())
    asked = probes.join(rules, key)
    granted = log.where("reserved_at is not null").groupBy(*key, F.col("reserved_at").alias("p")).agg(F.count("*").alias("n")).join(windows, key)
    instants = probes.where("at is not null").select(*key, "at").distinct().join(windows, key)
    none = F.lit(None).cast("double")
    ends = F.array(F.struct(F.lit(False).alias("_start"), F.col("at").alias("p")), F.struct(F.lit(True).alias("_start"), (F.col("at") - F.col("window_seconds")).alias("p")))
    points = instants.select(*by, "at", F.explode(ends).alias("x")).select(*by, "at", "x._start", "x.p", F.lit(0).cast("long").alias("n"), none.alias("r"))
    both = granted.select(*by, none.alias("at"), F.lit(False).alias("_start"), "p", "n", F.col("p").alias("r")).unionByName(points).withColumn("_slot", F.floor(F.col("p") / (F.col("window_seconds") / slots)))
    inside = Window.partitionBy(*by, "_slot")
    behind = inside.orderBy(F.desc("p"), F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)  # of an instant, points before requests
    ran = both.withColumn("_in", F.sum("n").over(inside.orderBy("p"))).withColumn("_last", F.max("r").over(inside.orderBy("p"))).withColumn("_next", F.min("r").over(behind)).where("at is not null")
    slot = Window.partitionBy(*by)  # a row for each slot that has one
    earlier, later = (slot.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_slot"), F.desc("_slot")))
    totals = both.groupBy(*by, "_slot").agg(F.sum("n").alias("_sum"), F.max("r").alias("_max"), F.min("r").alias("_min"))
    bases = totals.select(*by, "_slot", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.max("_max").over(earlier).alias("_before"), F.min("_min").over(later).alias("_after"))
    met = ran.join(bases, [*by, "_slot"]).select(*by, "at", "_start", (F.col("_in") + F.col("_base")).alias("_upto"), F.coalesce("_last", "_before").alias("_last"), F.coalesce("_next", "_after").alias("_next"))
    of = lambda start, c: F.max(F.when(F.col("_start") == start, F.col(c)))
    counted = met.groupBy(*by, "at").agg((of(False, "_upto") - of(True, "_upto")).alias("in_window"), of(True, "_next").alias("_first"), of(False, "_last").alias("_last"))
    seen = F.col("in_window") > 0
    counted = counted.select(*by, "at", "in_window", F.when(seen, F.col("_first")).alias("_first"), F.when(seen, F.col("_last")).alias("_last"))
    until = blocks.groupBy(*key).agg(F.max("blocked_until").alias("_until"))
    zero = F.lit(0.0)
    waits = F.greatest(zero, F.coalesce(F.col("_until") - F.col("at"), zero), F.coalesce(F.col("_last") + F.col("min_interval") - F.col("at"), zero), F.when(F.col("in_window") >= F.col("max_requests"), F.col("_first") + F.col("window_seconds") - F.col("at")).otherwise(zero))
    got = asked.join(counted, [*by, "at"], "left").join(until, key, "left").withColumn("in_window", F.coalesce("in_window", F.lit(0).cast("long")))
    return got.select(*probes.columns, "in_window", waits.alias("wait")).withColumn("allowed", F.col("wait") <= 0)


def quota_log_audit(log: DataFrame, window_seconds: int, key: tuple[str, ...] = ("provider", "bucket"), at: str = "reserved_at", slots: int = SLOTS) -> DataFrame:
    """``log`` with ``in_window`` (requests of the window up to and with this one), ``gap`` (seconds since the last earlier request) and ``at_once``
    (requests of this instant, which share the other two).

    Counts by instant are summed before they are shuffled. The number of requests up to an instant, less that up to the window's start, is what
    the window holds; both come from running totals in two levels: over a slot of time (a ``slots``-th of the window), and over the totals of
    a provider's slots, so no task holds the requests of a provider. A request whose time is null is in no window.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    width = window_seconds * 1_000_000
    instants = log.groupBy(*key, micros.alias("_t")).agg(F.count("*").alias("_n")).where("_t is not null")
    # a row where requests stand, and one where a window begins, which counts none
    points = F.array(F.struct(F.col("_t").alias("p"), F.col("_n").alias("n")), F.struct((F.col("_t") - width).alias("p"), F.lit(0).cast("long").alias("n")))
    both = instants.select(*key, "_t", F.posexplode(points).alias("_start", "x")).select(*key, "_t", (F.col("_start") == 1).alias("_start"), "x.p", "x.n")
    both = both.withColumn("_slot", F.floor(F.col("p") / max(1, width // slots)))
    inside = Window.partitionBy(*key, "_slot").orderBy("p")
    request = F.when(~F.col("_start"), F.col("p"))
    ran = both.withColumn("_in", F.sum("n").over(inside)).withColumn("_last", F.max(request).over(inside.rangeBetween(Window.unboundedPreceding, -1)))
    earlier = Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slot that has one
    totals = both.groupBy(*key, "_slot").agg(F.sum("n").alias("_sum"), F.max(request).alias("_max"))
    bases = totals.select(*key, "_slot", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.max("_max").over(earlier).alias("_before"))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    met = ran.join(bases, same(ran, bases, [*key, "_slot"])).select(*(ran[c] for c in key), "_t", "_start", (F.col("_in") + F.col("_base")).alias("_upto"), F.coalesce("_last", "_before").alias("_last"))
    counted = met.groupBy(*key, "_t").agg((F.max(F.when(~F.col("_start"), F.col("_upto"))) - F.max(F.when(F.col("_start"), F.col("_upto")))).alias("in_window"), F.max(F.when(~F.col("_start"), F.col("_last"))).alias("_last"))
    counted = counted.join(instants, same(counted, instants, [*key, "_t"])).select(*(counted[c] for c in key), counted["_t"], "in_window", ((counted["_t"] - F.col("_last")) / 1e6).alias("gap"), F.col("_n").alias("at_once"))
    rows = log.withColumn("_t", micros)
    got = rows.join(counted, [*same(rows, counted, key), rows["_t"] == counted["_t"]], "left")
    return got.select(*(rows[c] for c in log.columns), "in_window", "gap", "at_once")
