"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are one ragged numpy array of symbols. Each round, every pre-token applies its own pair of
lowest rank, all of them at once; what has no pair left is done, and its surviving symbols are its count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import free_name
from tallyweave.llm.vocabulary import Vocabulary, load, parse

#: Pre-tokens of the byte-level vocabulary.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Counts of pre-tokens that a Python process remembers; when full, the memory starts anew.
MEMORY = 400_000
#: Texts are counted together up to about this many characters.
STRIDE = 4_000_000
#: Limit of the contract's flag.
LIMIT = 1024

_NONE = np.int32(2**31 - 1)


class MergeTable:
    """Pairs of ids to (rank, merged id), for arrays."""

    def __init__(self, vocabulary: Vocabulary):
        pairs = np.array([(a << 32) | b for a, b in vocabulary.merged], np.int64)
        ranked = np.array(list(vocabulary.merged.values()), np.int32).reshape(-1, 2)
        order = np.argsort(pairs)
        self.pairs, self.rank, self.made = pairs[order], ranked[order, 0], ranked[order, 1]
        self.by_rank = np.empty(len(pairs), np.int32)
        self.by_rank[ranked[:, 0]] = ranked[:, 1]
        self.inner = np.array(vocabulary.inner, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.rank[at], _NONE)


def count_symbols(pieces: list[bytes], table: MergeTable) -> np.ndarray:
    """The number of tokens of each non-empty piece."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts = sizes.copy()
    symbols = table.inner[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    if len(symbols) < 2:
        return counts
    # rank of each symbol's pair with the next one of the same piece
    rank = np.full(len(symbols), _NONE, np.int32)
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    rank[inside] = table.ranks(symbols[inside], symbols[inside + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.r_[starts, len(symbols)])
        active = lowest != _NONE
        if not active.all():
            counts[owner[starts[~active]]] = lengths[~active]
            stay = np.repeat(active, lengths)
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            lowest, lengths = lowest[active], lengths[active]
            if not len(symbols):
                break
        chosen = np.flatnonzero(rank == np.repeat(lowest, lengths))
        # a pair of equal symbols can overlap the next: every second of a run applies, from the left
        begins = np.r_[True, np.diff(chosen) != 1]
        run = np.arange(len(chosen)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        chosen = chosen[run % 2 == 0]
        symbols[chosen] = table.by_rank[rank[chosen]]
        rank[chosen] = rank[chosen + 1]
        stay = np.ones(len(symbols), bool)
        stay[chosen + 1] = False
        place = np.cumsum(stay)[chosen] - 1
        symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
        # pairs that end or begin with a merged symbol have new ranks
        changed = np.unique(np.r_[place, place[place > 0] - 1])
        changed = changed[changed + 1 < len(symbols)]
        changed = changed[owner[changed] == owner[changed + 1]]
        rank[changed] = table.ranks(symbols[changed], symbols[changed + 1])
        last = np.r_[owner[1:] != owner[:-1], True]
        rank[last] = _NONE
    return counts


def token_counts(texts: list[str | None], vocabulary: Vocabulary, table: MergeTable, memory: dict[str, int]) -> list[int]:
    """Tokens of each text; pre-tokens that are not in ``memory`` are counted in one go per stride of texts."""
    out: list[int] = []
    held: list[tuple[list[str], int]] = []
    chars = 0

    def flush() -> None:
        new = list({p for pieces, _ in held for p in pieces if p not in memory})
        if len(memory) + len(new) > MEMORY:
            memory.clear()
            new = list({p for pieces, _ in held for p in pieces})
        counts = memory if len(new) <= MEMORY else {}
        if new:
            counts.update(zip(new, count_symbols([p.encode() for p in new], table).tolist(), strict=True))
        out.extend(sum(map(counts.__getitem__, pieces)) + special for pieces, special in held)
        held.clear()

    for text in texts:
        pieces, special = [], 0
        for n, part in enumerate(vocabulary.parts(text or "")):
            if n % 2:
                special += 1
            else:
                pieces += _PIECES.findall(part)
        held.append((pieces, special))
        chars += len(text or "")
        if chars >= STRIDE:
            flush()
            chars = 0
    flush()
    return out


#: Counts and merge tables of this Python process, by vocabulary.
_KEPT: dict[int, tuple[MergeTable, dict[str, int]]] = {}


def with_token_counts(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with a long column of token counts of each whole text, special strings inside texts being one token each.

    Null and empty texts have none. No shuffle; all other columns pass unchanged. Where ``df`` has a column ``out``, the new one's name
    has underscores added.
    """
    data = df.sparkSession.sparkContext.broadcast(load(path))

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        vocabulary = parse(data.value)
        if id(vocabulary) not in _KEPT:
            _KEPT[id(vocabulary)] = (MergeTable(vocabulary), {})
        table, memory = _KEPT[id(vocabulary)]
        return pa.array(token_counts(texts.to_pylist(), vocabulary, table, memory), pa.int64())

    return df.withColumn(free_name(df, out), of(F.col(f"`{text}`")))
