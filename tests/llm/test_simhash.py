"""Fingerprints, links, components and the surviving row of each group, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import similar as N
from tallyweave.llm import simhash as S
from tallyweave.llm.shared import Put


def brute_fingerprint(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


TEXTS = [None, "", " \t", "one", "One", "a b c", "A B C d", "ÄÖ x\x0by z q r", "s t u v w x y z " * 40, "s t u v w x y z " * 40, "word " * 5000, " ".join(map(str, range(3000)))]


def test_fingerprints_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("FP", F.lit(1))
    got = S.near_duplicates(df).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.fingerprint == format(brute_fingerprint(TEXTS[r.doc_id], 4), "016x")
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}


def blocks(spark, fps):
    return spark.createDataFrame([(x,) for x in fps], "block long").select("block", S.pivot_distances(F.col("block")).alias("away"))


@pytest.mark.parametrize("segments", [None, 5, 7])
def test_components_match_brute_force(spark, segments):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(500):  # chains of close fingerprints
        x = rng.choice(fps[-40:])
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(set(fps))]
    df, put = blocks(spark, signed), Put(spark)
    labels = {r.node_: r.label for r in S.components(S.linked_pairs(df, S.Rule(4, segments), put), put).collect()}
    want = brute_components([x & (1 << 64) - 1 for x in signed], 4)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    got = {x & (1 << 64) - 1: labels.get(x, x) for x in signed}
    assert groups(got) == groups(want)


def test_stars_take_no_round(spark):
    """Links that are stars around their smallest nodes are written once and not moved again; a chain is."""
    names, put = [], Put(spark)

    def noted(df, name):
        names.append(name)
        return put(df, name)

    labelled = lambda pairs: {r.node_: r.label for r in S.components(spark.createDataFrame(pairs, "a long, b long"), noted).collect()}
    assert labelled([(1, 2), (3, 1), (5, 4), (2, 1)]) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} and names == ["links"]
    assert labelled([(1, 2), (2, 3), (4, 3)]) == dict.fromkeys((1, 2, 3, 4), 1) and "stars" in names
    assert labelled([(7, 7)]) == {}


def test_large_buckets_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 16)
    rng = random.Random(1)
    centre = rng.getrandbits(63)
    fps = sorted({centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(300)})
    put = Put(spark)
    labels = {r.label for r in S.components(S.linked_pairs(blocks(spark, fps), S.CONTRACT, put), put).collect()}
    assert labels == {min(fps)}


def test_bucket_links_by_pivots():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 60, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, 400, dtype=np.uint64)))
    table = np.bitwise_count(S.pivot_fingerprints()[:, None] ^ fps[None, :]).astype(np.int8)
    a, b = S.bucket_links(fps, table, 4)
    assert len(a) == len(fps) - len(set(brute_components(fps.tolist(), 4).values())) and len(b) == len(a)


def test_ids_null_repeated_and_columns_clashing(spark):
    rows = [(3, "x y z w"), (3, "x y z w"), (None, "x y z w"), (None, "lone text here now"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("e").alias("tie"), F.lit(1).alias("node"), F.lit(2).alias("block"), F.lit(3).alias("_key"), F.lit(4).alias("_OWN"), F.lit(5).alias("keep_k"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in S.near_duplicates(df).collect() if r.component_id is not None)
    assert got == [(False, 3, 3), (False, 3, 3), (False, 7, 7), (True, 0, 3)]
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text) == [(-1, "lone text here now"), (3, "x y z w")]
    assert kept.count() == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0 and N.keep_one(df).count() == 0


def test_near_copies_go_and_clean_texts_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    clean = [[word() for _ in range(300)] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)]
    for i in range(20):  # three words changed: a similarity of about 0.9
        w = list(clean[i])
        for _ in range(3):
            w[rng.randrange(300)] = word()
        rows.append((1000 + i, " ".join(w)))
    kept = {r.doc_id for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(60)) <= kept  # no clean text goes
    assert len(kept) == 60  # and every near copy does


@pytest.mark.parametrize("group_rows", [1, 3, 1000])
def test_groups_are_those_of_exact_similarity(spark, monkeypatch, group_rows):
    monkeypatch.setattr(N, "SAMPLE_TEXTS", 60)
    monkeypatch.setattr(N, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(N, "BLOCK_ROWS", 4)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passage, texts = [word() for _ in range(30)], []
    for _ in range(50):
        w = [word() for _ in range(rng.choice((6, 40, 150, 400)))]
        w[3:3] = passage if rng.random() < 0.4 else []
        texts.append(w)
        for _ in range(rng.randrange(5)):  # similarities on both sides of the least one
            v = list(w)
            for _ in range(1 + round(len(w) * rng.uniform(0, 0.05))):
                v[rng.randrange(len(v))] = word()
            texts.append(v)
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    label = list(range(len(texts)))
    at = []
    for i, x in enumerate(sets):
        for j in range(i):
            alike = len(x & sets[j]) / len(x | sets[j])
            at.append(alike)
            if len(x & sets[j]) * 5 >= 4 * len(x | sets[j]):
                label = [label[j] if v == label[i] else v for v in label]
    assert sum(0.8 <= a < 0.85 for a in at) > 5 and sum(0.7 < a < 0.8 for a in at) > 5
    first = {v: label.index(v) for v in label}
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    kept = {r.doc_id for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(first.values())


def test_fingerprints_bound_the_difference():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(300, 400)], rng.integers(0, 2**63, rng.integers(0, 90), dtype=np.uint64)])) for _ in range(60)]
    bits, n = np.stack([N.parity(x) for x in sets]), np.array([len(x) for x in sets])
    away = np.stack([N.distances(N.references(), x) for x in bits]).astype(np.int32)
    a, b = np.triu_indices(60, 1)
    passed = set(N.within(bits, away, n, a, b)[0].tolist())
    alike = {i for i, (x, y) in enumerate(zip(a, b, strict=True)) if N.alike(len(np.intersect1d(sets[x], sets[y])), n[x], n[y])}
    assert 50 < len(alike) and alike <= passed and len(passed) < len(a)
    long = [np.unique(np.concatenate([x + np.uint64(i << 40) for i in range(3)])) for x in sets]
    wide = [N.wide_parity(x) for x in long]
    assert len({len(x) for x in wide}) > 1
    for x, y in zip(a, b, strict=True):
        if N.alike(len(np.intersect1d(long[x], long[y])), len(long[x]), len(long[y])):
            assert N.wide_within(wide[x], len(long[x]), wide[y], len(long[y]))
