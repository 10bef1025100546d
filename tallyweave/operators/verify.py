"""Reconciliation and data quality: archives, members, read-back, rollback, recovery, preflight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import text as t
from tallyweave.operators.history import latest

MIB = 1024 * 1024
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".gif")


def archive_safety(members: DataFrame, max_entries: int = 5_000, max_entry_bytes: int = 512 * MIB, max_total_bytes: int = 4096 * MIB, max_depth: int = 20, max_ratio: float = 1_000.0) -> DataFrame:
    """(archive_id, reason, entry_no): the first violation of each archive in entry order, null for a safe one.

    Sizes run up within an archive, which has a bounded number of entries: archives over ``max_entries`` are refused by
    their count before the running total. Folders count in names and depth, not in sizes.
    """
    counts = members.groupBy("archive_id").agg(F.count("*").alias("n"))
    crowded = counts.where(F.col("n") > max_entries).select("archive_id", F.lit("too many entries").alias("reason"), F.lit(None).cast("int").alias("entry_no"))
    rows = members.join(counts.where(F.col("n") <= max_entries).select("archive_id"), "archive_id", "left_semi")
    name = F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(name, "/"), lambda p: ~p.isin("", "."))
    folded = F.rtrim(F.lower(name), F.lit("/"))
    order = Window.partitionBy("archive_id").orderBy("entry_no")
    size = F.when(F.coalesce("is_directory", F.lit(False)), F.lit(0)).otherwise(F.coalesce("size", F.lit(0)))
    seen = Window.partitionBy("archive_id", "_folded").orderBy("entry_no")
    marked = rows.withColumn("_folded", folded).withColumn("_copy", F.row_number().over(seen)).withColumn("_total", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    file = ~F.coalesce("is_directory", F.lit(False))
    reason = (
        F.when((name == "") | F.startswith(name, F.lit("/")) | name.rlike("^[A-Za-z]:") | F.array_contains(parts, ".."), "unsafe path")
        .when(F.size(parts) > max_depth, "path too deep")
        .when(F.col("_copy") > 1, "duplicate path")
        .when(F.coalesce("is_link", F.lit(False)), "link")
        .when(F.coalesce("is_encrypted", F.lit(False)), "encrypted")
        .when(file & (F.col("size") > max_entry_bytes), "entry too large")
        .when(file & (F.col("_total") > max_total_bytes), "archive too large")
        .when(file & (F.col("compressed_size") > 0) & (F.col("size") / F.col("compressed_size") > max_ratio), "compression ratio")
    )
    found = marked.withColumn("reason", reason)
    first = found.groupBy("archive_id").agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("entry_no", "reason"))).alias("v")).select("archive_id", F.col("v.reason").alias("reason"), F.col("v.entry_no").alias("entry_no"))
    return first.unionByName(crowded)


def running_totals(members: DataFrame, key: str = "archive_id", order: str = "entry_no", amount: str = "size", out: str = "running") -> DataFrame:
    """``members`` with the sum of sizes up to each entry."""
    return members.withColumn(out, F.sum(amount).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def archive_profile(members: DataFrame, info_name: str = "comicinfo.xml", max_info_bytes: int = 2 * MIB) -> DataFrame:
    """(archive_id, entries, pages, info_entries, info_error): counts, and whether there is at most one metadata entry of allowed size."""
    file = F.lower(F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^.*/", ""))
    image = F.concat(F.lit("."), F.substring_index(file, ".", -1)).isin(*IMAGES) & file.contains(".")
    info = file == info_name
    got = members.groupBy("archive_id").agg(F.count("*").alias("entries"), F.count_if(image).alias("pages"), F.count_if(info).alias("info_entries"), F.max(F.when(info, F.col("size"))).alias("_size"))
    return got.withColumn("info_error", F.when(F.col("info_entries") > 1, "several metadata entries").when(F.col("_size") > max_info_bytes, "metadata entry too large")).drop("_size")


def multivolume(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths that belong to an archive in several volumes: ``.partNN.rar``, ``.rNN``, or an archive beside an ``.rNN`` of its stem."""
    name = F.lower(F.col(path))
    rows = paths.withColumn("_stem", F.regexp_replace(name, r"\.[^./]*$", ""))
    pieces = rows.where(name.rlike(r"\.r\d{2,3}$")).select("_stem").distinct()
    alone = rows.where(name.rlike(r"\.part\d+\.rar$") | name.rlike(r"\.r\d{2,3}$"))
    beside = rows.where(name.rlike(r"\.(?:rar|cbr)$") & ~name.rlike(r"\.part\d+\.rar$")).join(pieces, "_stem", "left_semi")
    return alone.unionByName(beside.select(*rows.columns)).drop("_stem")


def reconcile_members(before: DataFrame, after: DataFrame, key: str = "archive_id", ignore: str = "comicinfo.xml") -> DataFrame:
    """(key, name, status): added, removed, changed (hash), moved (position) or same, by folded name."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = df.where(~F.coalesce("is_directory", F.lit(False))).select(key, F.lower("path").alias("name"), F.col("entry_no").alias(f"{tag}_at"), F.col("sha256").alias(f"{tag}_hash"))
        return rows.where(F.col("name") != ignore)

    met = side(before, "b").join(side(after, "a"), [key, "name"], "full_outer")
    status = F.when(F.col("b_at").isNull(), "added").when(F.col("a_at").isNull(), "removed").when(~F.col("b_hash").eqNullSafe(F.col("a_hash")), "changed").when(F.col("b_at") != F.col("a_at"), "moved").otherwise("same")
    return met.select(key, "name", status.alias("status"))


def metadata_readback(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected fields (keys, field, op set or clear, value) that are not as written, with ``problem``.

    Dates agree to the stated precision, numbers as numbers, languages by base, ISBN by digits.
    """
    met = expected.join(actual.select(*keys, "field", F.col("value").alias("found")), [*keys, "field"], "left")
    e, a, f = F.col("value"), F.col("found"), F.lower("field")
    same = F.when(f.isin("date", "publication_date", "release_date"), t.same_date(e, a)).when(f.isin("language", "languageiso"), t.same_language(e, a)).when(f.isin("series_index", "volume", "year", "month", "day"), t.same_number(e, a)).when(f.startswith("isbn"), t.same_isbn(e, a)).otherwise(e.eqNullSafe(a))
    problem = F.when(F.col("op") == "clear", F.when(t.filled(a).isNotNull(), "not cleared")).when(a.isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "differs")
    return met.withColumn("problem", problem).where("problem is not null")


def unowned_lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metadata rows that were there before and are not any more; empty if the rest was preserved (as sets)."""
    return before.subtract(after)


def structure_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ordered lists (position, value, ...) on one side only, with ``side``; empty if the structure is unchanged."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def _hash_of(rows: DataFrame, inventory: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the current hash of the file that a path column names, null if it is not there."""
    return rows.join(inventory.select(F.col("path").alias(column), F.col("sha256").alias(out)), column, "left")


def rollback_preview(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """(run_id, item_id, possible, action): what undoing each item would take."""
    rows = reduce(lambda df, x: _hash_of(df, inventory, *x), (("destination_path", "_d"), ("source_path", "_s"), ("archive_path", "_a")), items)
    expected = F.coalesce(t.filled(F.col("destination_hash")), t.filled(F.col("staged_hash")))
    source, archive = F.coalesce(F.col("_s") == F.col("planned_source_hash"), F.lit(False)), F.coalesce(F.col("_a") == F.col("planned_source_hash"), F.lit(False))
    keep, store, move = (F.col("lifecycle_policy") == x for x in ("preserve", "archive_after_verify", "move_after_verify"))
    action = (
        F.when(~F.col("state").isin("committed", "cleanup_pending", "cleaned", "complete"), "none")
        .when(expected.isNull() | F.col("_d").isNull(), "manual")
        .when(F.col("_d") != expected, "refuse")
        .when(keep & source, "remove_unchanged_destination")
        .when(store & F.col("archive_path").isNotNull() & source, "remove_unchanged_destination")
        .when(store & archive & F.col("_s").isNull(), "restore_archive_then_remove_destination")
        .when(move & F.col("_s").isNull(), "impossible")
        .otherwise("manual")
    )
    return rows.select("run_id", "item_id", action.alias("action")).withColumn("possible", F.col("action").isin("remove_unchanged_destination", "restore_archive_then_remove_destination"))


def recovery_inspection(items: DataFrame, inventory: DataFrame, invalid: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, item_id, state, presence and match of source, staging and destination, action, manual).

    Items of invalidated plans need nothing; ``runs`` (id, plan_id) links them to ``invalid`` (plan_id, reason).
    """
    rows = reduce(lambda df, x: _hash_of(df, inventory, *x), (("destination_path", "_d"), ("source_path", "_s"), ("staging_path", "_g")), items)
    expected = F.coalesce(t.filled(F.col("destination_hash")), t.filled(F.col("staged_hash")))
    there, good, state = F.col("_d").isNotNull(), F.coalesce(F.col("_d") == expected, F.lit(False)), F.col("state")
    # fixed values: the texts of the actions
    action = (
        F.when(state == "complete", "none; item is complete")
        .when((state == "committing") & good, "recognize verified destination commit, then resume lifecycle")
        .when(state.isin("verified", "committing") & ~there, "publish retained verified staging output with no-clobber commit")
        .when(state.isin("committed", "cleanup_pending") & good, "resume or recognize planned source lifecycle")
        .when(state.isin("preflight_ok", "staging", "staged", "failed"), "retry staging only if source and destination preconditions still hold")
        .otherwise("manual intervention required; no safe automatic transition is proven")
    )
    got = rows.select("run_id", "item_id", "state", F.col("_s").isNotNull().alias("source_exists"), (F.col("_s") == F.col("planned_source_hash")).alias("source_matches"), (F.col("_g") == F.col("staged_hash")).alias("staging_matches"), there.alias("destination_exists"), (F.col("_d") == expected).alias("destination_matches"), action.alias("action"))
    got = got.withColumn("manual", F.startswith(F.col("action"), F.lit("manual")))
    if invalid is None or runs is None:
        return got
    void = runs.select(F.col("id").alias("run_id"), "plan_id").join(invalid.groupBy("plan_id").agg(F.min("reason").alias("reason")), "plan_id").select("run_id", "reason")
    met = got.join(void, "run_id", "left")
    return met.withColumn("manual", F.col("manual") & F.col("reason").isNull()).withColumn("action", F.when(F.col("reason").isNotNull(), F.format_string("none; plan is invalidated (%s)", "reason")).otherwise(F.col("action"))).drop("reason")


def reset_eligibility(requests: DataFrame, apply_items: DataFrame, apply_runs: DataFrame, inventory: DataFrame, roots: DataFrame) -> DataFrame:
    """``requests`` (destination_path, target_path) with ``reason``, null if the destination may go back to the target.

    Its newest complete record must have its current hash, the target must be free and under one of ``roots`` (root).
    """
    done = apply_items.where("state = 'complete'").join(apply_runs.where("status = 'complete'").select(F.col("id").alias("run_id")), "run_id", "left_semi")
    last = latest(done.select("destination_path", "destination_hash", "completed_at"), ["destination_path"], "completed_at").select("destination_path", "destination_hash", F.lit(True).alias("_known"))
    taken = inventory.select(F.col("path").alias("target_path"), F.lit(True).alias("_taken"))
    # the parents of a path meet the roots by equality
    parents = requests.select("target_path", F.explode(path_prefixes(F.col("target_path"))).alias("root")).join(roots.select(F.regexp_replace("root", "/+$", "").alias("root")), "root", "left_semi").select("target_path", F.lit(True).alias("_under")).distinct()
    met = _hash_of(requests, inventory, "destination_path", "_now").join(last, "destination_path", "left").join(taken, "target_path", "left").join(parents, "target_path", "left")
    reason = (
        F.when(F.col("_now").isNull(), "destination is not a file").when(F.col("_taken"), "target exists").when(F.col("_under").isNull(), "target is outside the incoming roots").when(F.col("_known").isNull(), "no completed record")
        .when(F.coalesce("destination_hash", F.lit("")) == "", "record has no hash").when(F.col("destination_hash") != F.col("_now"), "destination changed")
    )
    return met.select(*requests.columns, reason.alias("reason"))


def path_prefixes(path: Column) -> Column:
    """A path and all folders above it."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def estimated_space(format: Column, size: Column, inventory: Column) -> Column:
    """Bytes that an item needs while it is written: at least 64 MiB."""
    need = F.when(format == "cbr", F.greatest(size * 4, inventory * 2 + size)).otherwise(F.greatest(size * 2, inventory + size))
    return F.greatest(F.lit(64 * MIB).cast("bigint"), F.floor(need * 1.25).cast("bigint"))


def space_by_device(items: DataFrame, capacity: DataFrame) -> DataFrame:
    """(device, required, free, enough): items (device, format, size, inventory_size) against ``capacity`` (device, free)."""
    need = items.groupBy("device").agg(F.sum(estimated_space(F.col("format"), F.col("size"), F.coalesce("inventory_size", F.lit(0)))).alias("required"))
    return need.join(capacity, "device", "left").withColumn("enough", F.coalesce(F.col("free") >= F.col("required"), F.lit(False)))


def preflight(items: DataFrame, inventory: DataFrame, capacity: DataFrame) -> DataFrame:
    """``items`` with ``problems``: what forbids writing them now.

    Needs source_path, planned_source_hash, size, signature, destination_path, relative_path, root, archive_path, device and format.
    """
    now = inventory.select(F.col("path").alias("source_path"), F.col("sha256").alias("_s"), F.col("size").alias("_z"), F.col("signature").alias("_g"))
    met = _hash_of(_hash_of(items.join(now, "source_path", "left"), inventory, "destination_path", "_d"), inventory, "archive_path", "_a")
    short = space_by_device(items.select("device", "format", "size", F.lit(0).alias("inventory_size")), capacity).where(~F.col("enough")).select("device", F.lit(True).alias("_full"))
    met = met.join(short, "device", "left")
    inside = F.startswith(F.col("destination_path"), F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/")))
    agrees = F.col("destination_path") == F.concat_ws("/", F.regexp_replace("root", "/+$", ""), F.col("relative_path"))
    problems = F.array_compact(F.array(
        F.when(F.col("_s").isNull(), "source missing"), F.when(F.col("_z") != F.col("size"), "size changed"), F.when(F.col("_s") != F.col("planned_source_hash"), "hash changed"), F.when(F.col("_g") != F.col("signature"), "signature mismatch"),
        F.when(F.col("_d").isNotNull(), "destination exists"), F.when(F.col("_a").isNotNull(), "archive exists"), F.when(~inside, "destination outside its root"), F.when(inside & ~agrees, "relative and absolute path disagree"), F.when(F.col("_full"), "not enough space"),
    ))
    return met.select(*items.columns, problems.alias("problems"))
