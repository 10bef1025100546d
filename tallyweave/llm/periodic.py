"""Periodic run detection by recursive frequency splitting and a lag scan of what is left.

A run of period q has at least four of each of its words, so a word that stands fewer than four times in a segment splits it; the parts
are counted anew until none changes. Segments that survive are scanned for lags, all segments of a batch at once as numpy arrays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import free_name

#: A run has this many words and this many periods at least; each of its words stands that many times in it.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text whose words are held as strings at once, and characters of texts whose segments are worked on together.
STRETCH, TOGETHER = 1 << 20, 4 << 20
#: Levels of splitting that recount whole segments; deeper ones subtract the smaller parts, so that no text costs its square.
LEVELS = 12

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, cut at white space about every ``STRETCH`` bytes."""
    start = 0
    while start < len(text):
        m = _SPACE.search(text, min(start + STRETCH, len(text)))
        end = m.start() if m else len(text)
        yield text[start:end].split()  # bytes split at the six ASCII white spaces
        start = end + 1


def _coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts as numbers, where each text begins, and the word of each number."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, starts, n = [], [0], 0
    for t in texts:
        for words in _words(t):
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            n += len(words)
        starts.append(n)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.array(starts), list(ids)


def _settled(codes: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """The stable segments of one that is still splitting, by counting only the smaller parts: n log n however deep it goes."""
    places: defaultdict[int, list[int]] = defaultdict(list)
    for i in range(lo, hi):
        places[int(codes[i])].append(i)
    tally = {w: len(p) for w, p in places.items()}
    out, work = [], deque([(lo, hi, tally, [w for w, c in tally.items() if c < LEAST_PERIODS])])
    while work:
        a, b, tally, rare = work.pop()
        cuts = sorted(i for w in rare for i in places[w][bisect_left(places[w], a) : bisect_left(places[w], b)])
        if not cuts:
            out.append((a, b))
            continue
        ends = [a - 1, *cuts, b]
        parts = [(x + 1, y) for x, y in zip(ends, ends[1:], strict=False) if y - x - 1 > 0]
        if not parts:
            continue
        largest = max(parts, key=lambda p: p[1] - p[0])
        for w in rare:
            tally.pop(w, None)
        fell: set[int] = set()
        for part in parts:
            if part == largest:
                continue
            own: defaultdict[int, int] = defaultdict(int)
            for i in range(*part):
                own[int(codes[i])] += 1
            for w, c in own.items():
                tally[w] -= c
                fell.add(w)
            if part[1] - part[0] >= LEAST_WORDS:
                work.append((*part, own, [w for w, c in own.items() if c < LEAST_PERIODS]))
        if largest[1] - largest[0] >= LEAST_WORDS:
            work.append((*largest, tally, [w for w in fell if 0 < tally[w] < LEAST_PERIODS]))
    return out


def split(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the segments that no rare word splits, six words long at least, for texts that begin at ``starts``."""
    lo, hi = starts[:-1], starts[1:]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    size = int(codes.max(initial=0)) + 1
    for level in range(LEVELS + 1):
        long = hi - lo >= LEAST_WORDS
        lo, hi = lo[long], hi[long]
        if not len(lo) or level == LEVELS:
            break
        length = hi - lo
        at = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
        segment = np.repeat(np.arange(len(lo)), length)
        _, which, times = np.unique(segment * np.int64(size) + codes[at], return_inverse=True, return_counts=True)
        rare = times[which] < LEAST_PERIODS
        stable = np.bincount(segment, rare, len(lo)) == 0
        done.append((lo[stable], hi[stable]))
        # what is left of the segments that change: stretches between their rare words
        keep = ~rare & ~stable[segment]
        before = np.concatenate([[False], keep[:-1] & (segment[1:] == segment[:-1])])
        after = np.concatenate([keep[1:] & (segment[1:] == segment[:-1]), [False]])
        lo, hi = at[keep & ~before], at[keep & ~after] + 1
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        done.append(tuple(map(np.array, zip(*got, strict=True))) if (got := _settled(codes, a, b)) else (lo[:0], hi[:0]))
    lo, hi = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (lo, hi)
    order = np.argsort(lo)
    return lo[order].astype(np.int64), hi[order].astype(np.int64)


def scan(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run in the segments, by start, then period.

    Lags are scanned by ranges from ``a`` to ``1.5 a``, so that a segment of m words costs m log m for each range, not m for each lag. In a run
    of period q in the range, the block of ``3 a`` words at each place holds two periods, so the nearest place behind it where the
    same block stands is q words away (a nearer one would give the run a smaller period). The places where that lag is q, all next to
    each other, are the run's but for its last ``3 a + q - 1`` words; so each run is found once, at its smallest period.
    """
    found: list[np.ndarray] = []
    length = hi - lo
    if not len(lo):
        return (np.zeros(0, np.int64),) * 3
    at = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
    left = np.repeat(hi, length) - at  # words from here to the segment's end
    segment = np.repeat(np.arange(len(lo)), length)
    named, power = np.unique(codes[at], return_inverse=True)[1].astype(np.int64), 1
    a = 1
    while LEAST_PERIODS * a <= length.max():
        block, most = 3 * a, a + a // 2
        while 2 * power <= block:  # names of blocks twice as long
            both = np.full(len(at), -1, np.int64)
            fits = np.flatnonzero(left >= 2 * power)
            both[fits] = np.unique(named[fits] * np.int64(len(at)) + named[fits + power], return_inverse=True)[1]
            named, power = both, 2 * power
        place = np.flatnonzero((left >= block) & (length[segment] >= LEAST_PERIODS * a))
        key = named[place] * np.int64(len(at)) + named[place + block - power]
        order = np.argsort(key, kind="stable")
        one, two = place[order[:-1]], place[order[1:]]
        hit = (key[order[:-1]] == key[order[1:]]) & (segment[one] == segment[two]) & (two - one >= a) & (two - one <= most)
        start, lag = one[hit], (two - one)[hit]
        order = np.lexsort((start, lag))
        start, lag = start[order], lag[order]
        if len(start):
            first = np.concatenate([[True], (start[1:] != start[:-1] + 1) | (lag[1:] != lag[:-1]) | (segment[start[1:]] != segment[start[:-1]])])
            heads = np.flatnonzero(first)
            tails = np.concatenate([heads[1:], [len(start)]]) - 1
            q = lag[heads]
            size = start[tails] - start[heads] + block + q
            enough = size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
            found.append(np.stack([at[start[heads]], size, q])[:, enough])
        a = most + 1
    start, size, q = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((q, start))
    return start[order], size[order], q[order]


_OUT = pa.struct([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.string())])
_OUT_SQL = "struct<n_runs:bigint,start:bigint,length:bigint,period:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,runs_sha256:string,collapsed_sha256:string,collapsed:string>"


def _measured(texts: list[bytes], spans: bool) -> list[dict]:
    codes, starts, words = _coded(texts)
    start, size, period = scan(codes, *split(codes, starts))
    gone = np.zeros(len(codes) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + size, -1)
    kept = np.cumsum(gone[:-1]) == 0
    of = np.searchsorted(starts, start, side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        a, b = cuts[i], cuts[i + 1]
        s, n, q = start[a:b] - starts[i], size[a:b], period[a:b]
        best = int(np.lexsort((q, s, -n))[0]) if b > a else None
        runs = hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), n.tolist(), q.tolist(), strict=True)).encode())
        stays = codes[starts[i] : starts[i + 1]][kept[starts[i] : starts[i + 1]]]
        collapsed = hashlib.sha256()
        pieces = []
        for j in range(0, len(stays), STRETCH):
            piece = (b" " if j else b"") + b" ".join([words[c] for c in stays[j : j + STRETCH].tolist()])
            collapsed.update(piece)
            if spans:
                pieces.append(piece)
        row = {"n_runs": int(b - a), "start": None, "length": None, "period": None, "runs": None, "runs_sha256": runs.hexdigest(), "collapsed_sha256": collapsed.hexdigest(), "collapsed": None}
        if best is not None:
            row |= {"start": int(s[best]), "length": int(n[best]), "period": int(q[best])}
        if spans:
            row |= {"runs": [{"start": x, "length": y, "period": z} for x, y, z in zip(s.tolist(), n.tolist(), q.tolist(), strict=True)], "collapsed": b"".join(pieces).decode()}
        out.append(row)
    return out


def with_runs(df: DataFrame, text: str = "text", out: str = "periodic", spans: bool = True) -> DataFrame:
    """``df`` with the struct column ``out`` for each text's periodic runs.

    ``n_runs``; ``start``, ``length`` and ``period`` of the longest (ties: smallest start, then period; null without a run); ``runs``, all of
    them by start, then period; ``collapsed``, the words but those behind the first period of a run, joined by one space; SHA-256 digests
    of the runs and of the collapsed text. ``spans=False`` leaves ``runs`` and ``collapsed`` null and returns the digests alone. A null text
    counts as empty: no run, digests of nothing. Rows are independent, repeated ones get equal values; nothing is shuffled. All
    other columns pass; where ``df`` has a column ``out``, the new one's name has underscores added. A text is worked on by one task, whose memory follows that text.
    """
    out = free_name(df, out)
    mark = free_name(df, "_bytes")
    kept = df.withColumn(mark, F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    return kept.select(*(F.col(f"`{c}`") for c in df.columns), _runs_of(spans)(F.col(mark)).alias(out))


def _runs_of(spans: bool):
    @F.arrow_udf(_OUT_SQL)
    def runs(texts: pa.Array) -> pa.Array:
        rows: list[dict] = []
        held, size = [], 0
        for v in texts:
            held.append(v.as_py())
            size += len(held[-1])
            if size >= TOGETHER:
                rows += _measured(held, spans)
                held, size = [], 0
        return pa.array(rows + (_measured(held, spans) if held else []), _OUT)

    return runs
