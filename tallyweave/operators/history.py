"""Append-only histories: latest rows, links, folds, appends and what follows from them.

Rows are never updated; every current state is an aggregation over the log. ``max_by`` aggregates partially before the
shuffle, so a key with a long history does not land whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.operators.numbering import numbered

KEY = ["source_fingerprint", "media_signature"]
ACCEPTING = ("accepted", "work_accepted", "manual_identity")
CLOSED = (*ACCEPTING, "rejected", "unresolved", "skipped")
TYPES = (*CLOSED, "manual_override")


def latest(rows: DataFrame, keys: list[str], order: str | Column = "id") -> DataFrame:
    """The row with the largest ``order`` of each key, all columns."""
    by = F.col(order) if isinstance(order, str) else order
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r"))
    return got.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*rows.columns)


def with_supersedes(rows: DataFrame, keys: list[str], order: str = "id", out: str = "supersedes_id") -> DataFrame:
    """``rows`` with the id of the previous row of their chain."""
    return rows.withColumn(out, F.lag(order).over(Window.partitionBy(*keys).orderBy(order)))


def authorising(decisions: DataFrame) -> DataFrame:
    """(key, id, head_id, head_type): the latest accepting decision of each key whose head is not a refusal."""
    accepts = F.col("decision_type").isin(*ACCEPTING)
    got = decisions.groupBy(*KEY).agg(F.max(F.when(accepts, F.col("id"))).alias("id"), F.max("id").alias("head_id"), F.max_by("decision_type", "id").alias("head_type"))
    return got.where(F.col("id").isNotNull() & ~F.col("head_type").isin("rejected", "unresolved", "skipped"))


def override_fold(decisions: DataFrame) -> DataFrame:
    """(key, field, value): overrides that are in force: the last word on a field is a set, not a clear.

    Payloads of overrides have ``overrides`` (field to value) and ``cleared_fields``; within a row, sets come before clears.
    """
    parsed = decisions.where("decision_type = 'manual_override'").select(*KEY, "id", F.from_json("payload_json", "overrides map<string, string>, cleared_fields array<string>").alias("p"))
    sets = parsed.select(*KEY, "id", F.explode("p.overrides").alias("field", "value")).withColumn("step", F.lit(0))
    clears = parsed.select(*KEY, "id", F.explode("p.cleared_fields").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("step"))
    last = sets.unionByName(clears).groupBy(*KEY, "field").agg(F.max_by(F.struct("step", "value"), F.struct("id", "step")).alias("x"))
    return last.where("x.step = 0").select(*KEY, "field", "x.value")


def append_decisions(history: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows in the shape of the history, refused rows with ``reason``).

    ``new`` has the key, decision_type, candidate_key, source_evidence_hash, candidate_data_hash, payload_json, created_at, batch_id and
    record_type (of the candidate, or null). Runs are refused as identities, works are accepted as works only, manual identities need
    a title or series, overrides must be valid JSON, a cleared field must be set. Ids follow the history's, in the order of
    time and key; ``supersedes_id`` links each to the head of its chain.
    """
    payload = F.from_json("payload_json", "identity map<string, string>, cleared_fields array<string>, overrides map<string, string>")
    filled = lambda k: F.coalesce(F.try_element_at(payload["identity"], F.lit(k)), F.lit("")) != ""
    is_set = override_fold(history).groupBy(*KEY).agg(F.collect_set("field").alias("set_fields"))
    met = new.join(is_set, KEY, "left")
    unset = F.size(F.array_except(F.coalesce(payload["cleared_fields"], F.array().cast("array<string>")), F.coalesce("set_fields", F.array().cast("array<string>")))) > 0
    reason = (
        F.when(~F.col("decision_type").isin(*TYPES), "unknown decision type")
        .when(F.col("decision_type").isin("accepted", "work_accepted") & (F.col("record_type") == "comic_run"), "run records are context, not identities")
        .when(F.col("decision_type").isin("accepted", "work_accepted", "rejected") & F.col("candidate_key").isNull(), "a candidate is required")
        .when((F.col("decision_type") == "manual_identity") & ~(filled("title") | filled("series_title")), "manual identity requires a title or series title")
        .when((F.col("decision_type") == "manual_override") & payload["overrides"].isNull() & payload["cleared_fields"].isNull(), "an override sets or clears fields")
        .when((F.col("decision_type") == "manual_override") & unset, "a cleared field is not set")
    )
    judged = met.withColumn("reason", reason).withColumn("decision_type", F.when((F.col("decision_type") == "accepted") & (F.col("record_type") == "book_work"), "work_accepted").otherwise(F.col("decision_type")))
    good = judged.where("reason is null")
    top = F.broadcast(history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))
    placed = numbered(good, ["created_at", *KEY], "_n").join(top).withColumn("id", (F.col("_top") + F.col("_n")).cast("bigint")).drop("_n", "_top")
    heads = history.groupBy(*KEY).agg(F.max("id").alias("_head"))
    chain = Window.partitionBy(*KEY).orderBy("id")
    linked = placed.join(heads, KEY, "left").withColumn("supersedes_id", F.coalesce(F.lag("id").over(chain), F.col("_head")))
    return linked.select(*history.columns), judged.where("reason is not null").select(*new.columns, "reason")


def append_run_choices(history: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) run choices: an empty run id and clearing without an active choice are refused."""
    keys = ["group_key", "provider"]
    heads = latest(history, keys).select(*keys, F.col("id").alias("_head"), (F.col("decision_type") != "cleared").alias("_active"))
    met = new.join(heads, keys, "left")
    reason = F.when(~F.col("decision_type").isin("selected", "manual", "cleared"), "unknown choice").when((F.col("decision_type") != "cleared") & (F.coalesce("provider_run_id", F.lit("")) == ""), "a run id is required").when((F.col("decision_type") == "cleared") & ~F.coalesce("_active", F.lit(False)), "no choice to clear")
    judged = met.withColumn("reason", reason)
    top = F.broadcast(history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))
    good = numbered(judged.where("reason is null"), ["created_at", *keys], "_n").join(top)
    good = good.withColumn("id", (F.col("_top") + F.col("_n")).cast("bigint")).withColumn("supersedes_id", F.coalesce(F.lag("id").over(Window.partitionBy(*keys).orderBy("id")), F.col("_head")))
    return good.select(*history.columns), judged.where("reason is not null").select(*new.columns, "reason")


def active_choices(choices: DataFrame) -> DataFrame:
    """(group_key, provider, id, chosen_run) of groups whose latest choice is not cleared."""
    return latest(choices, ["group_key", "provider"]).where("decision_type <> 'cleared'").select("group_key", "provider", "id", F.col("provider_run_id").alias("chosen_run"))


def suppress_rejected(scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """``scores`` with ``suppressed``, which also clears ``eligible``: the latest decision on the candidate is a rejection of the same two hashes.

    ``scores`` has the key, candidate_key, source_evidence_hash and candidate_data_hash.
    """
    keys = [*KEY, "candidate_key"]
    last = latest(decisions.where("candidate_key is not null"), keys).where("decision_type = 'rejected'").select(*keys, F.col("source_evidence_hash").alias("_e"), F.col("candidate_data_hash").alias("_d"))
    met = scores.join(last, keys, "left")
    same = F.coalesce((F.col("_e") == F.col("source_evidence_hash")) & (F.col("_d") == F.col("candidate_data_hash")), F.lit(False))
    return met.withColumn("suppressed", same).withColumn("eligible", F.col("eligible") & ~same).drop("_e", "_d")


# ---- plans and their preconditions


def supersessions(plan_items: DataFrame, new_plan_id: Column | int, apply_runs: DataFrame) -> DataFrame:
    """(old_plan_id, new_plan_id): older plans with a source of the new one that were never applied."""
    new = F.lit(new_plan_id) if isinstance(new_plan_id, int) else new_plan_id
    mine = plan_items.where(F.col("plan_id") == new).select("source_fingerprint", F.col("plan_id").alias("new_plan_id")).distinct()
    older = plan_items.select(F.col("plan_id").alias("old_plan_id"), "source_fingerprint").join(mine, "source_fingerprint").where("old_plan_id < new_plan_id").select("old_plan_id", "new_plan_id").distinct()
    return older.join(apply_runs.select(F.col("plan_id").alias("old_plan_id")), "old_plan_id", "left_anti")


def all_supersessions(plan_items: DataFrame, apply_runs: DataFrame) -> DataFrame:
    """Supersession for every plan at once: a plan with its next newer one that shares a source, unless it was applied."""
    chain = Window.partitionBy("source_fingerprint").orderBy("plan_id")
    nexts = plan_items.select("plan_id", "source_fingerprint").distinct().withColumn("new_plan_id", F.lead("plan_id").over(chain))
    found = nexts.where("new_plan_id is not null").groupBy(F.col("plan_id").alias("old_plan_id")).agg(F.min("new_plan_id").alias("new_plan_id"))
    return found.join(apply_runs.select(F.col("plan_id").alias("old_plan_id")), "old_plan_id", "left_anti")


def invalidations(preconditions: DataFrame, decisions: DataFrame, run_choices: DataFrame) -> DataFrame:
    """(plan_id, reason): plans with a precondition whose decision or run choice is no longer the newest."""
    heads = decisions.groupBy("source_fingerprint").agg(F.max("id").alias("head"))
    changed = preconditions.join(heads, "source_fingerprint").where("decision_head_id <> head").select("plan_id", F.lit("identity decision changed after plan creation").alias("reason"))
    groups = run_choices.groupBy(F.col("group_key").alias("run_group_key")).agg(F.max("id").alias("head"))
    moved = preconditions.where("run_group_key is not null").join(groups, "run_group_key").where(~F.col("run_group_decision_id").eqNullSafe(F.col("head"))).select("plan_id", F.lit("run choice changed after plan creation").alias("reason"))
    return changed.unionByName(moved).groupBy("plan_id").agg(F.min("reason").alias("reason"))


def stale_preconditions(preconditions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Preconditions whose decision is not the newest of the fingerprint, whatever its media signature (a quirk that is kept)."""
    heads = decisions.groupBy("source_fingerprint").agg(F.max("id").alias("newest"))
    return preconditions.join(heads, "source_fingerprint", "left").where(F.col("newest").isNull() | (F.col("decision_head_id") != F.col("newest")))


def active_plans(plans: DataFrame, invalid: DataFrame, superseded: DataFrame, apply_runs: DataFrame) -> DataFrame:
    """Plans that are not invalidated, superseded or applied."""
    gone = reduce(DataFrame.unionByName, [invalid.select("plan_id"), superseded.select(F.col("old_plan_id").alias("plan_id")), apply_runs.select("plan_id")])
    return plans.join(gone.select(F.col("plan_id").alias("id")).distinct(), "id", "left_anti")


def reviewed_without_plan(sources: DataFrame, decisions: DataFrame, preconditions: DataFrame, apply_runs: DataFrame) -> DataFrame:
    """Paths of sources whose head accepts, or overrides an earlier acceptance, and stands in no applied plan."""
    heads = decisions.groupBy(*KEY).agg(F.max("id").alias("head"), F.max_by("decision_type", "id").alias("type"), F.max(F.when(F.col("decision_type").isin(*ACCEPTING), F.col("id"))).alias("accepted"))
    good = heads.where(F.col("type").isin(*ACCEPTING) | ((F.col("type") == "manual_override") & F.col("accepted").isNotNull()))
    used = preconditions.join(apply_runs.select("plan_id"), "plan_id", "left_semi").select(F.col("decision_head_id").alias("head"))
    return _paths(sources, good.join(used, "head", "left_anti"))


def unresolved_review(sources: DataFrame, decisions: DataFrame) -> DataFrame:
    """Paths of sources whose head is unresolved."""
    return _paths(sources, latest(decisions, KEY).where("decision_type = 'unresolved'"))


def _paths(sources: DataFrame, keys: DataFrame) -> DataFrame:
    keyed = sources.select("path", F.col("sha256").alias("source_fingerprint"), F.concat_ws(":", "format", F.col("size").cast("string")).alias("media_signature"))
    return keyed.join(keys, KEY, "left_semi").select("path").distinct()


def needs_review(sources: DataFrame, decisions: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """``sources`` (key, evidence_hash) with ``needs_review``: no decision, changed evidence, an open type, a reopening marker, or nothing newer than the baseline.

    ``baseline`` (source_fingerprint, baseline_id) names decisions that a newer one must follow.
    """
    last = latest(decisions, KEY).select(*KEY, F.col("id").alias("_id"), F.col("decision_type").alias("_t"), F.col("source_evidence_hash").alias("_h"), F.get_json_object("payload_json", "$.reason").alias("_r"))
    met = sources.join(last, KEY, "left")
    reopened = (F.col("_t") == "unresolved") & F.col("_r").isin("run_group_changed", "review_reopened")
    open_ = F.col("_id").isNull() | ~F.col("_h").eqNullSafe(F.col("evidence_hash")) | ~F.col("_t").isin(*CLOSED) | F.coalesce(reopened, F.lit(False))
    if baseline is not None:
        met = met.join(baseline, "source_fingerprint", "left")
        open_ = open_ | F.coalesce(F.col("_id") == F.col("baseline_id"), F.lit(False))
    return met.withColumn("needs_review", open_).withColumn("head_type", F.col("_t")).drop("_id", "_t", "_h", "_r", "baseline_id")


def replaced_invalidations(invalid: DataFrame, plan_items: DataFrame, apply_runs: DataFrame, apply_items: DataFrame) -> DataFrame:
    """(plan_id, replaced): whether all unfinished sources of an invalidated plan are in later plans that were completed."""
    planned = plan_items.join(invalid.select("plan_id"), "plan_id", "left_semi")
    last = latest(apply_runs.select("plan_id", F.col("id").alias("run_id"), "started_at"), ["plan_id"], F.struct("started_at", "run_id"))
    states = apply_items.select("run_id", "item_id", "state")
    met = planned.join(last.select("plan_id", "run_id"), "plan_id", "left").join(states, ["run_id", "item_id"], "left")
    open_ = met.where(~F.col("state").eqNullSafe(F.lit("complete"))).select("plan_id", "source_fingerprint").distinct()
    done = plan_items.join(apply_runs.where("status = 'complete'").select("plan_id"), "plan_id", "left_semi").groupBy("source_fingerprint").agg(F.max("plan_id").alias("_done"))
    residue = open_.join(done, "source_fingerprint", "left").groupBy("plan_id").agg(F.bool_and(F.coalesce(F.col("_done") > F.col("plan_id"), F.lit(False))).alias("replaced"))
    return invalid.select("plan_id").distinct().join(residue, "plan_id", "left").withColumn("replaced", F.coalesce("replaced", F.lit(True)))


def incompatible_with_run(sources: DataFrame, decisions: DataFrame, choices: DataFrame) -> DataFrame:
    """New ``unresolved`` rows for accepted sources of a group whose candidate has another run than the one chosen.

    ``sources`` has the key, group_key and evidence_hash; ``choices`` (group_key, chosen_run).
    """
    heads = latest(decisions, KEY).where(F.col("decision_type").isin("accepted", "work_accepted")).select(*KEY, F.get_json_object("payload_json", "$.candidate.run_id").alias("run_id"))
    met = sources.join(heads, KEY).join(choices.select("group_key", "chosen_run"), "group_key").where(~F.col("run_id").eqNullSafe(F.col("chosen_run")))
    payload = F.to_json(F.struct(F.lit("run_group_changed").alias("reason"), F.col("chosen_run").alias("selected_run_id"), F.lit(True).alias("explicit")))
    return met.select(*KEY, F.lit("unresolved").alias("decision_type"), F.col("evidence_hash").alias("source_evidence_hash"), payload.alias("payload_json"))


# ---- journal

# From each state of the journal, the states that may follow.
TRANSITIONS = {
    "pending": ("preflight_ok", "stale", "failed", "recovery_required"),
    "preflight_ok": ("staging", "stale", "recovery_required"),
    "staging": ("staged", "failed", "stale", "recovery_required"),
    "staged": ("verified", "failed", "stale", "recovery_required"),
    "verified": ("committing", "stale", "recovery_required"),
    "committing": ("committed", "stale", "recovery_required"),
    "committed": ("cleanup_pending", "complete", "recovery_required"),
    "cleanup_pending": ("cleaned", "recovery_required"),
    "cleaned": ("complete", "recovery_required"),
    "failed": ("staging", "stale", "recovery_required"),
}


def journal_violations(journal: DataFrame) -> DataFrame:
    """Journal rows with ``problem``: a step that is not allowed, or one that does not start where the last one ended.

    Rows of the run itself (no item) and error notes (same state twice) are exempt from the first rule; a first row may start anywhere.
    """
    chain = Window.partitionBy("run_id", "item_id").orderBy("id")
    rows = journal.where("item_id is not null").withColumn("previous", F.lag("to_state").over(chain))
    allowed = reduce(lambda acc, x: acc | ((F.col("from_state") == x[0]) & F.col("to_state").isin(*x[1])), TRANSITIONS.items(), F.lit(False))
    note = F.col("from_state") == F.col("to_state")
    problem = F.when(F.col("previous").isNotNull() & ~F.col("from_state").eqNullSafe(F.col("previous")), "gap").when(~F.coalesce(note, F.lit(False)) & ~F.coalesce(allowed, F.lit(False)), "not_allowed")
    return rows.withColumn("problem", problem).where("problem is not null").drop("previous")


def resume_state(apply_runs: DataFrame, plans: DataFrame, reviewed: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row (state, plan_id, count): what to do next: recovery before an open plan before planning before review.

    ``plans`` are the active ones; ``reviewed`` and ``unresolved`` are the path tables of the two queries above.
    """
    none = F.lit(None).cast("bigint")
    running = apply_runs.where(F.col("status").isin("preflighting", "running", "recovery_required")).agg(F.max_by("plan_id", "started_at").alias("plan_id"), F.count("*").alias("n")).where("n > 0")
    open_plan = plans.agg(F.max_by(F.struct("id", "status"), "id").alias("p"), F.count("*").alias("n")).where("n > 0")
    rows = [
        running.select(F.lit(0).alias("priority"), F.lit("recovery").alias("state"), F.col("plan_id").cast("bigint"), none.alias("count")),
        open_plan.select(F.lit(1).alias("priority"), F.col("p.status").alias("state"), F.col("p.id").cast("bigint").alias("plan_id"), none.alias("count")),
        reviewed.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(2).alias("priority"), F.lit("reviewed").alias("state"), none.alias("plan_id"), F.col("n").alias("count")),
        unresolved.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(3).alias("priority"), F.lit("review").alias("state"), none.alias("plan_id"), F.col("n").alias("count")),
    ]
    return reduce(DataFrame.unionByName, rows).orderBy("priority").limit(1).drop("priority")
