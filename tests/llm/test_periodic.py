"""Runs against brute force over every place and period, splitting against plain recursion, the registered query, and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import periodic as P
from tallyweave.llm import queries
from tests.conftest import SF


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(words[k] == words[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def hard_texts():
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "a b " * 4, "a b c " * 4 + "a", "a a a a a a b b b b b b", "x\x1fy " * 9, "é " * 300, "aab aab aaab " * 8]
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.choice("abc" if rng.random() < 0.7 else "abcdefghij") for _ in range(rng.choice((1, 2, 3, 5, 8, 13)))]
            reach = rng.randrange(1, 7 * len(unit) + 2)
            parts += (unit * reach)[:reach] + [rng.choice("abxyz") for _ in range(rng.randrange(4))]
        texts.append(" ".join(parts))
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(200))) for _ in range(80)]
    texts.append(" ".join((["a"] * 14 + ["b"]) * 9 + ["c"] + (["a", "b", "a", "a", "b", "b"] * 11)))
    return texts


def test_runs_against_brute_force(spark):
    texts = hard_texts() + ["one two three four"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("N_RUNS", F.lit("x"))
    got = P.with_runs(df).collect()
    assert len(got) == len(texts) and got[0].N_RUNS == "x"
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.k] or "")
        want = brute_runs(words)
        p = r.periodic
        assert [(x.start, x.length, x.period) for x in p.runs] == want, texts[r.k]
        assert p.n_runs == len(want) and p.collapsed == collapsed(words, want)
        assert p.collapsed_sha256 == hashlib.sha256(p.collapsed.encode()).hexdigest()
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (p.start, p.length, p.period) == best
    digests = {r.k: r.periodic for r in P.with_runs(df, spans=False).collect()}
    assert all(digests[r.k].runs_sha256 == r.periodic.runs_sha256 and digests[r.k].collapsed is None for r in got)
    assert P.with_runs(df.limit(0)).count() == 0


def plain_split(codes, lo, hi):
    if hi - lo < 6:
        return []
    n = Counter(codes[lo:hi])
    cuts = [i for i in range(lo, hi) if n[codes[i]] < 4]
    if not cuts:
        return [(lo, hi)]
    return [s for a, b in zip([lo - 1, *cuts], [*cuts, hi], strict=True) for s in plain_split(codes, a + 1, b)]


def chained(depth):
    """Each word falls below four only once the one before it has split the segment."""
    words = []
    for k in range(depth):
        words = [k, *words, k, k] if k == depth - 1 else [k + 1, k, *words, k, k]
    return words


def test_splitting_however_deep(monkeypatch):
    rng = random.Random(5)
    texts = [[rng.randrange(rng.choice((2, 5, 12))) for _ in range(rng.randrange(120))] for _ in range(200)] + [chained(60), [], [1] * 6]
    codes = np.array([w for t in texts for w in t], np.int32)
    starts = np.cumsum([0, *map(len, texts)])
    want = sorted((a + s, b + s) for t, s in zip(texts, starts, strict=False) for a, b in plain_split(t, 0, len(t)))
    for levels in (0, 1, 12, 1000):
        monkeypatch.setattr(P, "LEVELS", levels)
        lo, hi = P.split(codes, starts)
        assert list(zip(lo.tolist(), hi.tolist(), strict=True)) == want, levels


def test_long_texts_are_worked_on_in_stretches(monkeypatch):
    texts = [(t or "").encode() for t in hard_texts()]
    whole = P._measured(texts, True)
    monkeypatch.setattr(P, "STRETCH", 5)
    assert P._measured(texts, True) == whole
    long = (" ".join(map(str, range(40_000))) + " ") * 5
    row = P._measured([long.encode()], False)[0]
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 200_000, 40_000)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_periodic_runs(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words) if n < 1200 else [tuple(x) for x in zip(*(v.tolist() for v in scanned(words)), strict=True)]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def scanned(words):
    """Every lag compared as arrays, for texts too long for the brute force."""
    codes = np.unique(np.array(words, object).astype(str), return_inverse=True)[1]
    n, seen, out = len(codes), set(), []
    for q in range(1, n // 4 + 1):
        equal = np.concatenate([[0], (codes[:-q] == codes[q:]).astype(int), [0]])
        edges = np.diff(equal)
        for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            if e - s + q >= max(6, 4 * q) and (s, e + q) not in seen:
                seen.add((s, e + q))
                out.append((s, e - s + q, q))
    out.sort(key=lambda r: (r[0], r[2]))
    return np.array(out, np.int64).reshape(-1, 3).T


def test_tails_of_odd_texts(spark):
    keys = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(keys[0], None), (keys[1], ""), (keys[2], "one"), (keys[3], " a  b\nc d e f g h i j "), (None, "a b"), (1, "x  y")]
    got = {r.doc_id: r.text for r in queries.with_periodic_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[keys[0]] is None and got[keys[1]] == "" and got[keys[2]] == "one" and got[None] == "a b" and got[1] == "x  y"
    assert len(got[keys[3]].split()) == 10


def test_clashing_names(spark):
    got = P.with_runs(spark.createDataFrame([("a " * 9, 1, 2)], "text string, periodic int, _bytes int")).first()
    assert (got.periodic, got._bytes, got.periodic_.n_runs) == (1, 2, 1)
