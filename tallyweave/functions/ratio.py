"""Text similarity by longest matching blocks, the one comparison that has no native expression.

The ratio depends on the order of its arguments and on the blocks found: the longest common block, the earliest in the left text
and then in the right one, and so on to both sides of it. A suffix automaton of the right text finds a block in one walk over the left one.
Equal and empty pairs are decided without comparing; others are compared once per batch or, after an exchange of distinct pairs, once.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = "array<struct<l: string, r: string>>"
#: In a right text of so many characters, those that make up over one in a hundred begin no block, though blocks extend over them.
LONG, POPULAR_OF = 200, 100


class Automaton:
    """The suffix automaton of a sequence: states with transitions, suffix links, longest lengths and first end places."""

    def __init__(self, items: list, lo: int, hi: int):
        self.lo = lo
        self.next: list[dict] = [{}]
        self.link, self.size, self.end = [-1], [0], [lo - 1]
        last = 0
        for place in range(lo, hi):
            last = self._add(items[place], place, last)

    def _state(self, transitions: dict, link: int, size: int, end: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.size.append(size)
        self.end.append(end)
        return len(self.next) - 1

    def _add(self, item: object, place: int, last: int) -> int:
        new = self._state({}, 0, self.size[last] + 1, place)
        p = last
        while p >= 0 and item not in self.next[p]:
            self.next[p][item] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][item]
            if self.size[q] != self.size[p] + 1:  # a copy of q for the shorter texts that end here too
                copy = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1, self.end[q])
                while p >= 0 and self.next[p].get(item) == q:
                    self.next[p][item] = copy
                    p = self.link[p]
                self.link[q] = copy
                q = copy
            self.link[new] = q
        return new

    def longest(self, text: str, lo: int, hi: int) -> tuple[int, int, int]:
        """(place in ``text``, place in the sequence, length) of the longest common block, the earliest of equal ones."""
        best, state, length = (lo, self.lo, 0), 0, 0
        for i in range(lo, hi):
            c = text[i]
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
                if length > best[2]:
                    best = (i - length + 1, self.end[state] - length + 1, length)
        return best


def matched(left: str, right: str, whole: Automaton | None = None) -> int:
    """Characters in matching blocks. ``whole`` is the automaton of ``comparable(right)``, if it is at hand."""
    items = comparable(right)
    total, work = 0, [(0, len(left), 0, len(right))]
    while work:
        a, b, c, d = work.pop()
        automaton = whole if whole is not None and (c, d) == (0, len(right)) else Automaton(items, c, d)
        i, j, n = automaton.longest(left, a, b)
        while i > a and j > c and left[i - 1] == right[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < b and j + n < d and left[i + n] == right[j + n]:
            n += 1
        if n:
            total += n
            if a < i and c < j:
                work.append((a, i, c, j))
            if i + n < b and j + n < d:
                work.append((i + n, b, j + n, d))
    return total


def comparable(right: str) -> list:
    """The characters that may begin a block; the popular ones of a long text as places, which equal no character."""
    if len(right) < LONG:
        return list(right)
    often = {c for c, n in Counter(right).items() if n > len(right) // POPULAR_OF + 1}
    return [i if c in often else c for i, c in enumerate(right)]


@F.arrow_udf(T.DoubleType())
def _ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(ratios(left.to_pylist(), right.to_pylist()), pa.float64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _row_ratios(rows: pa.Array) -> pa.Array:
    """Ratios of the pairs of each row; a pair that stands in several rows of the batch is compared once."""
    listed = rows.to_pylist()
    distinct = list({(p["l"], p["r"]) for pairs in listed for p in pairs or []})
    known = dict(zip(distinct, ratios([a for a, _ in distinct], [b for _, b in distinct]), strict=True))
    return pa.array([[known[p["l"], p["r"]] for p in pairs or []] for pairs in listed], pa.list_(pa.float64()))


def ratios(left: list[str], right: list[str]) -> list[float]:
    """2 * matched characters / all characters of unequal, filled pairs; pairs with the same right text share its automaton."""
    out, kept, whole = [0.0] * len(left), None, None
    for n in sorted(range(len(left)), key=right.__getitem__):
        if right[n] != kept:
            kept, whole = right[n], Automaton(comparable(right[n]), 0, len(right[n]))
        out[n] = 2.0 * matched(left[n], kept, whole) / (len(left[n]) + len(kept))
    return out


def with_text_ratios(df: DataFrame, pairs: Column, out: str, on: list[str] | None = None) -> DataFrame:
    """``df`` with an array column: for an array of (l, r), 2 * matched characters / all characters of each pair.

    Null counts as empty, two empty texts agree; equal and empty pairs are decided without comparing. By default rows are compared where they are,
    each pair once per Arrow batch, and nothing is shuffled. ``on`` (columns that tell rows apart) asks for an exchange instead: the
    unequal pairs meet, each distinct one is compared once, and ratios join their rows. It pays where the same pairs stand in very many
    rows, as the rows are evaluated for the exchange and again for the result; rows that share the ``on`` columns still get ratios of their own pairs.
    """
    held = df.withColumn("_pairs", pairs.cast(PAIRS))
    unequal = F.array_distinct(F.filter("_pairs", lambda p: (p["l"] != p["r"]) & (p["l"] != "") & (p["r"] != "")))
    if on is None:
        # The function must stand in a step of its own, with a plain column as argument: Spark cannot lift it out of an expression
        # with lambdas. The generator keeps its argument's lambdas below, and being nondeterministic keeps it out of those above.
        held = held.select("*", F.explode(F.array(unequal)).alias("_unequal"))
        held = held.select("*", _row_ratios.asNondeterministic()(F.col("_unequal")).alias("_ratios"))
        found = lambda p: F.get("_ratios", (F.array_position("_unequal", p) - 1).cast("int"))
    else:
        keys = [F.col(f"`{c}`").alias(f"_on{i}") for i, c in enumerate(on)]
        names = [f"_on{i}" for i in range(len(on))]
        asked = held.select(*keys, F.explode(unequal).alias("p")).select(*names, "p.l", "p.r").distinct()
        scored = asked.select("l", "r").distinct().select("l", "r", _ratio("l", "r").alias("ratio"))
        entry = F.struct(F.struct("l", "r").alias("key"), F.col("ratio").alias("value"))
        notes = asked.join(scored, ["l", "r"]).groupBy(*names).agg(F.map_from_entries(F.collect_list(entry)).alias("_notes"))
        held = held.join(notes, [held[f"`{c}`"].eqNullSafe(notes[n]) for c, n in zip(on, names, strict=True)], "left")
        found = lambda p: F.try_element_at("_notes", p)
    one = lambda p: F.when(p["l"] == p["r"], 1.0).otherwise(F.coalesce(found(p), F.lit(0.0)))
    return held.select(*(F.col(f"`{c}`") for c in df.columns), F.transform("_pairs", one).alias(out))


def pair(left: Column, right: Column) -> Column:
    return F.struct(F.coalesce(left, F.lit("")).alias("l"), F.coalesce(right, F.lit("")).alias("r"))


def with_ratios(df: DataFrame, pairs: dict[str, tuple[Column, Column]], on: list[str] | None = None) -> DataFrame:
    """``df`` with a double column for each named pair of keys."""
    held = with_text_ratios(df, F.array(*(pair(a, b) for a, b in pairs.values())), "_all", on)
    return held.select(*df.columns, *(F.col("_all")[i].alias(n) for i, n in enumerate(pairs)))
