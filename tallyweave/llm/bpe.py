"""BPE encoding by a bounded-lookahead streaming transducer, and decoding by an incremental state machine."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import free_name
from tallyweave.llm.vocabulary import Vocabulary, load, parse

# What the library's Unicode tables know, as code point ranges in hexadecimal.
#: White space.
_WHITE = "9-d 20 85 a0 1680 2000-200a 2028-2029 202f 205f 3000"
#: Combining marks that its NFC, of an older Unicode version, does not know and therefore neither reorders nor composes.
_UNKNOWN_MARKS = (
    "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff "
    "10f46-10f50 10f82-10f85 11070 1133b 1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 "
    "11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)
#: Letters newer than Python's own tables that its patterns know.
_NEWER_LETTERS = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 "
    "113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
)
#: Numbers newer than Python's own tables that its patterns know.
_NEWER_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: Capitals newer than Python's own tables, with their small letters.
_NEWER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


def _points(ranges: str) -> set[int]:
    ends = [r.split("-") for r in ranges.split()]
    return {c for r in ends for c in range(int(r[0], 16), int(r[-1], 16) + 1)}


def _spans(points: set[int]) -> str:
    """The inside of a character class."""
    out, ordered = [], sorted(points)
    for c in ordered:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


def _later(kind: str, known: str) -> set[int]:
    """What the pattern module takes for this kind and the library does not know yet."""
    unassigned = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    return set(map(ord, regex.findall(kind, unassigned))) - _points(known)


_SPACE = _spans(_points(_WHITE))
_LATER_LETTERS, _LATER_NUMBERS = (_spans(_later(*x) | {0x10FFFF}) for x in ((r"\p{L}", _NEWER_LETTERS), (r"\p{N}", _NEWER_NUMBERS)))  # never empty
#: Pre-tokens of the vocabulary with word ends; what matches none is dropped.
_WORDS = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATER_LETTERS}]]+|[\p{{N}}--[{_LATER_NUMBERS}]]|[[^{_SPACE}\p{{L}}\p{{N}}]||[{_LATER_LETTERS}{_LATER_NUMBERS}]]+")
_MARKS = regex.compile(f"([{_spans(_points(_UNKNOWN_MARKS))}])")
_CAPITALS = regex.compile(f"[{_spans(set(_NEWER_CAPITALS))}]")
#: The same pre-tokens for text that has no character beyond U+024F, by explicit classes of Python's own, quicker engine.
_COMMON_LETTERS, _COMMON_NUMBERS = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼½¾"
_COMMON_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_COMMON_LETTERS}]+|[{_COMMON_NUMBERS}]|[^\t-\r \x85\xa0{_COMMON_LETTERS}{_COMMON_NUMBERS}]+")
_RARE = re.compile(r"[^\x00-\u024f]")
#: Characters, about, that are normalised at a time, and pre-tokens that are encoded, hashed and decoded at a time.
STRETCH, STRIDE = 1 << 16, 4096
#: Up to this many symbols are merged by the quicker way.
SHORT = 48
_NONE = (1 << 60, -1)
#: Encoded pre-tokens that a Python process remembers; when full, the memory starts anew.
MEMORY = 300_000


def merge(symbols: list[int], vocabulary: Vocabulary) -> list[tuple[int, int]]:
    """(token, its number of symbols) of a row of symbols: the pair of lowest rank, leftmost first, merges until none is left."""
    merged = vocabulary.merged
    n = len(symbols)
    if n <= SHORT:
        return _merge_short(symbols, merged)
    ids, width, after, before = list(symbols), [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merged[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merged]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if not width[i] or j >= n or (ids[i], ids[j]) != pair:
            continue
        ids[i] = merged[pair][1]
        width[i] += width[j]
        width[j] = 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := (ids[i], ids[k])) in merged:
                heapq.heappush(heap, (merged[p][0], i, p))
        if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in merged:
            heapq.heappush(heap, (merged[p][0], h, p))
    return [(ids[i], width[i]) for i in range(n) if width[i]]


def _merge_short(symbols: list[int], merged: dict[tuple[int, int], tuple[int, int]]) -> list[tuple[int, int]]:
    """The same by a list of ranks, which is quicker than a heap for a few symbols."""
    ids, width = list(symbols), [1] * len(symbols)
    found = [merged.get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
    ranks = [f[0] for f in found]
    while ranks and (low := min(ranks)) != _NONE[0]:
        i = ranks.index(low)
        ids[i] = found[i][1]
        width[i] += width[i + 1]
        del ids[i + 1], width[i + 1], ranks[i], found[i]
        for j in (i - 1, i):
            if 0 <= j < len(ranks):
                found[j] = merged.get((ids[j], ids[j + 1]), _NONE)
                ranks[j] = found[j][0]
    return list(zip(ids, width, strict=True))


class Transducer:
    """Symbols of one pre-token in, tokens out as soon as they are stable.

    A token is stable once the vocabulary's lookahead of symbols from its start is there. Symbols are taken a lookahead
    at a time, so at most twice that many are held, however long the pre-token is.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.held: list[int] = []
        self.room = vocabulary.lookahead

    def push(self, symbols: list[int]) -> list[int]:
        """Tokens that became stable with these symbols."""
        out: list[int] = []
        for start in range(0, len(symbols), self.room):
            self.held += symbols[start : start + self.room]
            if len(self.held) <= self.room:
                continue
            done = 0
            for token, width in merge(self.held, self.vocabulary):
                if len(self.held) - done < self.vocabulary.lookahead:
                    break
                out.append(token)
                done += width
            del self.held[:done]
        return out

    def close(self) -> list[int]:
        """The tokens of what is held, as nothing follows."""
        out = [token for token, _ in merge(self.held, self.vocabulary)] if self.held else []
        self.held = []
        return out


def encode_word(word: str, vocabulary: Vocabulary) -> list[int]:
    """The tokens of one pre-token: its bytes, the last with the word-end suffix, through the transducer."""
    data = word.encode()
    symbols = [vocabulary.inner[b] for b in data[:-1]] + [vocabulary.final[data[-1]]]
    transducer = Transducer(vocabulary)
    return transducer.push(symbols) + transducer.close()


def normalised(text: str) -> str:
    """NFC and lower case, character by character (no final sigma).

    The library also makes white space one space each; as no pre-token has any in it, that changes no token.
    """
    if not unicodedata.is_normalized("NFC", text):
        text = "".join(unicodedata.normalize("NFC", part) for part in _MARKS.split(text))
    if _RARE.search(text):
        text = _CAPITALS.sub(lambda m: chr(_NEWER_CAPITALS[ord(m[0])]), text).replace("\u03a3", "\u03c3")
    return text.lower()


def words_of(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, ``STRIDE`` at a time, of stretches that are normalised one by one.

    A stretch ends behind a space or line end: neither normalisation nor pre-tokens reach across one.
    """
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > STRETCH:
            end = 1 + max(text.rfind(x, start, start + STRETCH) for x in " \n")
            if not end:
                ends = [x for x in (text.find(" ", start), text.find("\n", start)) if x >= 0]
                end = 1 + min(ends, default=len(text) - 1)
        part = normalised(text[start:end])
        start = end
        found = (_WORDS if _RARE.search(part) else _COMMON_WORDS).findall(part)
        for n in range(0, len(found), STRIDE):
            yield found[n : n + STRIDE]


def encode(text: str, vocabulary: Vocabulary, memory: dict[str, list[int]]) -> Iterator[list[int]]:
    """The ids of a text, some at a time. ``memory`` holds encoded pre-tokens, up to ``MEMORY``."""
    for n, part in enumerate(vocabulary.parts(text)):
        if n % 2:
            yield [vocabulary.special[part]]
            continue
        for some in words_of(part):
            found = list(map(memory.get, some))
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        found[i] = memory.get(some[i]) or encode_word(some[i], vocabulary)
                        if len(some[i]) < 64:
                            memory[some[i]] = found[i]
                if len(memory) > MEMORY:
                    memory.clear()
            yield list(chain.from_iterable(found))


class Decoder:
    """Ids in, text out: tokens' bytes go through an incremental UTF-8 state, which holds an unfinished character.

    ``spaced`` renders tokens as the library does for a file without a decoder: the tokens' own strings, one
    space between. Otherwise byte symbols become their bytes and a word end becomes a space.
    """

    def __init__(self, vocabulary: Vocabulary, spaced: bool = True):
        self.between = b" " if spaced else b""
        self.bytes = _bytes_of(vocabulary, spaced)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def push(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = self.between.join(map(self.bytes.__getitem__, ids))
        if self.begun:
            data = self.between + data
        self.begun = True
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", True)


def _bytes_of(vocabulary: Vocabulary, spaced: bool) -> dict[int, bytes]:
    kept = vocabulary.__dict__.setdefault("_rendered", {})
    if spaced not in kept:
        if spaced:
            kept[spaced] = {i: t.encode() for i, t in vocabulary.tokens.items()}
        else:
            from tallyweave.llm.vocabulary import byte_symbols

            byte = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
            special, suffix = set(vocabulary.special), vocabulary.suffix
            of = lambda t: b"".join(byte[c] for c in t)
            kept[spaced] = {i: t.encode() if t in special else of(t.removesuffix(suffix)) + b" " if suffix and t.endswith(suffix) else of(t) for i, t in vocabulary.tokens.items()}
    return kept[spaced]


#: Encoded pre-tokens of this Python process, by vocabulary.
_MEMORY: dict[int, dict[str, list[int]]] = {}


def digests(text: str | None, vocabulary: Vocabulary, memory: dict[str, list[int]]) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the ids joined by a space, SHA-256 of the decoded text). Beyond the text itself, memory is
    that of a stretch, and of one pre-token where that is longer."""
    of_ids, of_text, decoder = hashlib.sha256(), hashlib.sha256(), Decoder(vocabulary)
    n, names = 0, vocabulary.names
    for ids in encode(text or "", vocabulary, memory):
        if ids:
            of_ids.update(((" " if n else "") + " ".join(map(names.__getitem__, ids))).encode())
            of_text.update(decoder.push(ids).encode())
            n += len(ids)
    of_text.update(decoder.close().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def encoded(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an array column of token ids. Null and empty texts get an empty array; other columns pass, and one named as
    ``ids`` gives the new one an underscore."""
    ids = free_name(df, ids)
    data = df.sparkSession.sparkContext.broadcast(load(path))

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        vocabulary = parse(data.value)
        memory = _MEMORY.setdefault(id(vocabulary), {})
        return pa.array(([i for ids in encode(t.as_py() or "", vocabulary, memory) for i in ids] for t in texts), pa.list_(pa.int32()))

    return df.withColumn(ids, of(F.col(f"`{text}`")))


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", spaced: bool = True) -> DataFrame:
    """``df`` with the text of an array column of ids; null gives empty text. Ids outside the vocabulary are an error.
    Other columns pass, and one named as ``out`` gives the new one an underscore."""
    out = free_name(df, out)
    data = df.sparkSession.sparkContext.broadcast(load(path))

    @F.arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        vocabulary = parse(data.value)

        def one(row: list[int] | None) -> str:
            decoder = Decoder(vocabulary, spaced)
            return decoder.push(row or []) + decoder.close()

        return pa.array((one(r.as_py()) for r in rows), pa.string())

    return df.withColumn(out, of(F.col(f"`{ids}`")))


def encoding_digests(df: DataFrame, path: str, text: str = "text", out: str = "encoding") -> DataFrame:
    """``df`` with a struct column (n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded.

    Null counts as empty: no ids, digests of the empty string. No shuffle; all other columns pass unchanged, and one named as
    ``out`` gives the new one an underscore.
    """
    out = free_name(df, out)
    data = df.sparkSession.sparkContext.broadcast(load(path))
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(texts: pa.Array) -> pa.Array:
        vocabulary = parse(data.value)
        memory = _MEMORY.setdefault(id(vocabulary), {})
        got = [digests(t.as_py(), vocabulary, memory) for t in texts]
        return pa.array([dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), x, strict=True)) for x in got], kind)

    return df.withColumn(out, of(F.col(f"`{text}`")))
