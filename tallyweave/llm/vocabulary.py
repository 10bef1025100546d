"""Merge lists and vocabularies read from a public tokenizer's JSON file; nothing is trained here."""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import regex


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, other = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in names:
            names[b] = chr(other)
            other += 1
    return [names[b] for b in range(256)]


@dataclass
class Vocabulary:
    """``merged`` maps a pair of ids to (rank, id of the merged token). ``lookahead`` is the number of symbols that
    settle the first token of a text: see ``sufficient_lookahead``."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    suffix: str
    merged: dict[tuple[int, int], tuple[int, int]] = field(init=False)
    tokens: dict[int, str] = field(init=False)
    lookahead: int = field(init=False)

    def __post_init__(self):
        self.merged = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(self.merges)}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.lookahead = sufficient_lookahead(self.merges, self.suffix)
        symbols = byte_symbols()
        #: ids as decimal texts
        self.names = {i: str(i) for i in self.tokens}
        #: ids of a byte inside and at the end of a pre-token
        self.inner = [self.ids[s] for s in symbols]
        self.final = [self.ids[s + self.suffix] for s in symbols]
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def parts(self, text: str) -> list[str]:
        """The text split at special strings; those are at odd places."""
        return self.special_split.split(text) if self.special_split else [text]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols from a token boundary on that settle the next token, whatever follows.

    Whether the token before a boundary merges with ``v`` by a rule (u, v) depends on what stands right of ``v``
    only through a rule (s, w) of lower rank that takes an end ``s`` of ``v`` away before; that rule in turn
    depends on what stands right of ``w`` through rules of still lower rank. Ranks fall along such a chain, so
    the longest one is found in one pass over the rules: ``reach[(u, v)]`` is the length of ``v`` plus the
    furthest reach of rules that could take an end of ``v``. The result is the largest length of ``u`` plus
    its reach.
    """
    length = lambda s: len(s.removesuffix(suffix)) if suffix else len(s)
    ends: dict[str, int] = defaultdict(int)  # furthest reach of rules that take an end of this token, proper ends included
    starts: dict[str, int] = defaultdict(int)  # furthest reach of the rules so far that begin with this token
    most = 1
    for u, v in merges:
        beyond = max(ends[v], starts[v])
        reach = length(v) + beyond
        ends[u + v] = max(ends[u + v], beyond)
        starts[u] = max(starts[u], reach)
        most = max(most, length(u) + reach)
    return most


@lru_cache(maxsize=4)
def parse(data: str) -> Vocabulary:
    """A vocabulary from the text of a tokenizer's JSON file; parsed once in each Python process."""
    read = json.loads(data)
    model = read["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Vocabulary(model["vocab"], merges, {t["content"]: t["id"] for t in read["added_tokens"]}, model.get("end_of_word_suffix") or "")


def load(path: str) -> str:
    """The text of a tokenizer file, read by the driver; tasks get it by broadcast (about 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
