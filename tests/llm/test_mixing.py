"""Targets, schedule and counts of the source mix."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import mixing as M


def water_filled(sizes, weights, cap):
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: float(cap * sizes[s]) for s in over}


def docs_of(spark, counts, seed=1):
    rng = random.Random(seed)
    rows, n = [], 0
    for source, docs in counts.items():
        for _ in range(docs):
            rows.append((n, "w " * rng.randrange(0, 120), source))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_counts(spark):
    docs = docs_of(spark, {"a": 400, "b": 10, "c": 60, "é": 60, None: 30})
    got = M.mixed(docs).collect()
    by = docs.select("doc_id", "source").collect()
    source = {r.doc_id: r.source for r in by}
    sizes = Counter()
    for r in got:
        sizes[source[r.doc_id]] += r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water_filled(sizes, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(M.BLOCK_WORDS, 0.02 * want[s]) for s in want), (taken, want)
    assert taken["b"] == want["b"] == 3 * sizes["b"]  # a capped source


@pytest.mark.parametrize("words", [1, 10, 40, 65, 129, 700])
def test_small_sources_meet_their_targets(spark, words):
    docs = spark.createDataFrame([(0, "w " * words, "small"), *((i, "w " * 1000, "a") for i in range(1, 101))], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in M.mixed(docs).collect()}
    assert got[0].target == 3 * words == got[0].taken
    assert abs(sum(r.taken for r in got.values()) - got[1].target - 3 * words) <= 1000


def test_blocks_scale_with_the_whole(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_BLOCKS", 100)
    monkeypatch.setattr(M, "LEAST_BLOCKS", 16)
    docs = docs_of(spark, {"a": 400, "b": 30, "c": 5})
    targets = {r.source: r.target for r in M.targets(docs.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).cast("long").alias("source_size"))).collect()}
    got = M.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= max(M.BLOCK_WORDS, 0.05 * r.target) for r in got) and set(targets) == {r.source for r in got}


def test_reruns_agree_whatever_the_partitioning(spark):
    docs = docs_of(spark, {"a": 50, "b": 80})
    one = {tuple(r) for r in M.mixed(docs).collect()}
    assert one == {tuple(r) for r in M.mixed(docs.repartition(7).orderBy(F.desc("doc_id"))).collect()}


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(0, 0, 500, 100), (1, 0, 50, 197), (2, 1, 40, 3)], "n long, part int, blocks long, quota long")
    rows = sorted((r.slot, r.n, r.rank, r.epoch, r.block) for r in M.schedule(sources).collect())
    assert len(rows) == 300 == len({r[0] for r in rows}) and Counter(r[1] for r in rows) == {0: 100, 1: 197, 2: 3}
    for start in range(0, 270, 30):  # every stretch has nearly a third of the first source
        assert abs(sum(r[1] == 0 for r in rows[start : start + 30]) - 10) <= 2
    for n, blocks in ((0, 500), (1, 50), (2, 40)):  # ranks follow the slots, blocks the ranks
        assert [r[2:] for r in rows if r[1] == n] == [(i, i // blocks, i % blocks) for i in range(sum(r[1] == n for r in rows))]


def test_points_are_multiples_of_the_golden_ratio(spark):
    sources = spark.createDataFrame([], "n long, part int, blocks long, quota long")
    assert M.schedule(sources).count() == 0
    assert len({(x * M.GOLDEN) % (1 << 32) for x in (0, 1, 2, 3, 70_000, (1 << 32) - 1)}) == 6


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mixed(empty).count() == 0 and M.resampled(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["size"], r.taken, r.target) for r in M.mixed(blank).collect()} == {(0, 0, 0.0)}
    same = spark.createDataFrame([(1, "a b c", "s", 5)] * 4 + [(None, "d e", "s", 5)], "doc_id long, text string, source string, size int")
    got = M.mixed(same).collect()
    assert len(got) == 5 and sum(r.taken for r in got) > 0
    same = same.select("*", *(F.lit(77).alias(c) for c in ("_k", "_size", "_times", "_copy", "_key")))
    again = M.resampled(same)
    assert {r._copy for r in again.collect()} == {77}
    assert again.columns == same.columns and again.count() >= 5


def test_resampled_follows_the_mix(spark):
    docs = docs_of(spark, {"a": 200, "b": 100}, 4)
    taken = {r.doc_id: (r.taken, r["size"]) for r in M.mixed(docs).collect()}
    times = Counter(r.doc_id for r in M.resampled(docs).collect())
    assert all(abs(times[k] - t / s) <= 0.5 for k, (t, s) in taken.items() if s)


@pytest.mark.parametrize("sizes", [(30, 30, 30), (64, 64), (200, 150, 190), (7, 200, 5, 1)])
def test_tiny_sources_meet_their_targets_uncapped_and_capped(spark, sizes):
    rows, n = [], 0
    for i, size in enumerate(sizes):
        for words in [size // 3, size - size // 3]:
            rows.append((n, "w " * words, f"s{i}"))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mixed(docs).collect()
    order = {f"s{i}": s for i, s in enumerate(sizes)}
    want = water_filled(order, {s: 1 + i % 3 for i, s in enumerate(sorted(order))}, 3)
    taken = Counter()
    for r in got:
        taken[rows[r.doc_id][2]] += r.taken
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= max(1, 0.02 * want[s]) for s in want), (taken, want)
