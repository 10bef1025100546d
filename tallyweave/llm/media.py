"""Media columns: baseline JPEG written and read in numpy, with DC-only luminance thumbnails and their hashes.

``stored`` writes each text's bytes as a baseline JPEG in which every 8 x 8 block is one even grey: the byte itself. With a
DC quantiser of 8 the block's DC coefficient is the sample minus 128, so the picture holds the bytes without loss
as 8-bit samples, and its DC-only thumbnail is the payload. Rows of 64 blocks are restart intervals of their own.

``media_features`` takes any baseline JPEG: it parses the markers, Huffman-decodes the scans (all restart intervals of a
batch in step, as arrays), rebuilds the luminance thumbnail from the DC coefficients, and hashes it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import free_name

#: Payload bytes in a row of blocks, and rows of blocks in one picture (65,535 pixels at most).
ROW, ROWS = 64, 8191
#: Payload bytes that are coded together.
STRIDE = 2_000_000

# The luminance DC code of the JPEG standard, annex K: codes of each length, and their categories.
_DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
_DC_SYMBOLS = tuple(range(12))
#: The AC code of the pictures written here: end of block alone, as one bit.
_AC_LENGTHS, _AC_SYMBOLS = (1, *[0] * 15), (0,)


def _codes(lengths: Iterable[int], symbols: Iterable[int]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol of a Huffman table."""
    out, code, rest = {}, 0, iter(symbols)
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[next(rest)] = (code, bits)
            code += 1
        code <<= 1
    return out


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00, *_DC_LENGTHS, *_DC_SYMBOLS])),
        _segment(0xC4, bytes([0x10, *_AC_LENGTHS, *_AC_SYMBOLS])),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


#: Rows of samples that are coded at once: coding takes some 100 bytes a sample, whatever the length of a text.
CODED_ROWS = 8192


def _scan_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes of rows of samples, stuffed, one row behind the other, and each row's length."""
    parts = [_coded_rows(samples[i : i + CODED_ROWS]) for i in range(0, len(samples), CODED_ROWS)]
    data, lengths = zip(*parts, strict=True)
    return np.concatenate(data), np.concatenate(lengths)


def _coded_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    level = samples.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.int16(0))
    size = np.ceil(np.log2(np.arange(512) + 1)).astype(np.int64)  # bits of a magnitude
    category = size[np.abs(diff)]
    table = _codes(_DC_LENGTHS, _DC_SYMBOLS)
    code, bits = (np.array([table[c][i] for c in range(12)], np.int64) for i in (0, 1))
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff)
    # DC code, its extra bits and the end of block, a single zero bit
    value = ((code[category] << category) | extra) << 1
    length = bits[category] + category + 1
    pad = -length.sum(axis=1) % 8
    value, length = np.c_[value, (1 << pad) - 1], np.c_[length, pad]
    left = (value << (16 - length)).astype(">u2")
    spread = np.unpackbits(left.view(np.uint8).reshape(-1, 2), axis=1)
    data = np.packbits(spread[np.arange(16) < length.reshape(-1, 1)])
    ends = np.cumsum(length.sum(axis=1) // 8)
    full = data == 255
    stuffed = np.repeat(data, 1 + full)
    stuffed[np.flatnonzero(full) + np.cumsum(full)[full]] = 0
    grown = np.r_[0, np.cumsum(full)][ends] + ends
    return stuffed, np.diff(grown, prepend=0)


def write_jpegs(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of ``ROW`` bytes) as one JPEG, or several behind each other if it is very long."""
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    coded, lengths = _scan_rows(data)
    ends = np.cumsum(lengths)
    # a restart marker after each row, numbered from the first row of its picture
    first, pictures, row = np.zeros(len(data), np.int64), [], 0
    for n, payload in enumerate(payloads):
        for start in range(0, len(payload) // ROW, ROWS):
            rows = min(ROWS, len(payload) // ROW - start)
            pictures.append((n, row, rows))
            first[row : row + rows] = row
            row += rows
    out = np.empty(len(coded) + 2 * len(data), np.uint8)
    at = ends + 2 * np.arange(len(data))
    hole = np.ones(len(out), bool)
    hole[at] = hole[at + 1] = False
    out[hole] = coded
    out[at], out[at + 1] = 0xFF, 0xD0 + (np.arange(len(data)) - first) % 8
    parts: list[list[bytes]] = [[] for _ in payloads]
    raw = out.tobytes()
    for n, begin, rows in pictures:
        low = 0 if not begin else int(at[begin - 1]) + 2
        parts[n] += (_header(rows), raw[low : int(at[begin + rows - 1])], b"\xff\xd9")
    return [b"".join(p) for p in parts]


@dataclass
class Component:
    name: int
    h: int
    v: int
    quantiser: int
    dc: bytes = b""
    ac: bytes = b""


@dataclass
class Picture:
    """What the markers of one baseline JPEG say. ``scans`` are (components, place of the coded bytes, restart interval)."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    scans: list[tuple[list[Component], int, int, int]] = field(default_factory=list)
    quantiser: dict[int, int] = field(default_factory=dict)


class Malformed(ValueError):
    """Not a complete baseline JPEG."""


def parse_jpegs(data: bytes) -> list[Picture]:
    """The pictures of a byte string that holds one JPEG or several behind each other."""
    pictures, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise Malformed("no start of image")
        picture, tables, interval = Picture(), {}, 0
        at += 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 2 > len(data) or data[at] != 0xFF:
                raise Malformed("marker expected")
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            if at + 2 > len(data):
                raise Malformed("cut off")
            end = at + struct.unpack_from(">H", data, at)[0]
            body = data[at + 2 : end]
            if end > len(data) or end < at + 2:
                raise Malformed("cut off")
            at = end
            try:
                if marker == 0xC0:
                    bits, picture.height, picture.width, n = struct.unpack_from(">BHHB", body)
                    if bits != 8 or not picture.height or not picture.width or not n:
                        raise Malformed("not a baseline frame")
                    picture.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                    if any(not 1 <= x <= 4 for c in picture.components for x in (c.h, c.v)):
                        raise Malformed("sampling factor")
                elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    raise Malformed("not a baseline frame")
                elif marker == 0xDB:
                    p = 0
                    while p < len(body):
                        wide = body[p] >> 4
                        picture.quantiser[body[p] & 15] = body[p + 1] << 8 | body[p + 2] if wide else body[p + 1]
                        p += 129 if wide else 65
                elif marker == 0xC4:
                    p = 0
                    while p < len(body):
                        n = sum(body[p + 1 : p + 17])
                        tables[body[p]] = body[p + 1 : p + 17 + n]
                        p += 17 + n
                elif marker == 0xDD:
                    interval = struct.unpack(">H", body[:2])[0]
                elif marker == 0xDA:
                    named = {c.name: c for c in picture.components}
                    chosen = []
                    for i in range(body[0]):
                        c = named[body[1 + 2 * i]]
                        c.dc, c.ac = tables[body[2 + 2 * i] >> 4], tables[16 | body[2 + 2 * i] & 15]
                        chosen.append(c)
                    stop = at
                    while (stop := data.find(b"\xff", stop)) >= 0 and stop + 1 < len(data) and (data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7):
                        stop += 2
                    if stop < 0:
                        raise Malformed("cut off")
                    picture.scans.append((chosen, at, stop, interval))
                    at = stop
            except (IndexError, KeyError, struct.error) as e:
                raise Malformed("broken segment") from e
        if not picture.scans:
            raise Malformed("no scan")
        pictures.append(picture)
    if not pictures:
        raise Malformed("no start of image")
    return pictures


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) for each 16 bits that may come next; length 0 for no code."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, bits) in _codes(table[:16], table[16:]).items():
        length[code << 16 - bits : code + 1 << 16 - bits], symbol[code << 16 - bits : code + 1 << 16 - bits] = bits, s
    return length, symbol


_LOOKUPS: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if data not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[data] = _lookup(data)
    return _LOOKUPS[data]


def _unstuffed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded bytes without stuffing and restart markers, and where each restart interval begins."""
    mark = np.flatnonzero(data[:-1] == 255)
    after = data[mark + 1]
    restart = mark[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[mark[after == 0] + 1] = False
    keep[restart] = keep[restart + 1] = False
    starts = np.r_[0, np.cumsum(keep)[restart]] if len(restart) else np.zeros(1, np.int64)
    return data[keep], starts


def _decode_in_step(data: np.ndarray, starts: np.ndarray, mcus: np.ndarray, blocks: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """DC coefficients (interval, MCU, block of the MCU) of intervals that share their tables.

    ``blocks`` has (component, DC table, AC table) of each block of an MCU. Each step decodes one code of every
    interval that is not yet at its end.
    """
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint32)
    words = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    limit = (len(words) - 1) * 8
    pos = starts.astype(np.int64) * 8
    out = np.zeros((len(starts), int(mcus.max()), len(blocks)), np.int32)
    last = np.zeros((max(c for c, _, _ in blocks) + 1, len(starts)), np.int64)
    order = np.argsort(-mcus, kind="stable")
    counts = mcus[order]

    def peek(p: np.ndarray) -> np.ndarray:
        p = np.minimum(p, limit)
        return (words[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    for m in range(out.shape[1]):
        live = order[: np.searchsorted(-counts, -m, side="left")]
        for n, (component, dc, ac) in enumerate(blocks):
            length, symbol = _table(dc)
            bits = peek(pos[live])
            if not length[bits].all():
                raise Malformed("no such code")
            size, p = symbol[bits], pos[live] + length[bits]
            if size.max(initial=0) > 11:
                raise Malformed("no such category")
            value = peek(p).astype(np.int64) >> (16 - size)
            value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
            last[component, live] += value
            out[live, m, n] = last[component, live]
            p += size
            length, symbol = _table(ac)
            todo, k = np.arange(len(live)), np.ones(len(live), np.int64)
            while len(todo):
                bits = peek(p[todo])
                if not length[bits].all():
                    raise Malformed("no such code")
                run, size = symbol[bits] >> 4, symbol[bits] & 15
                p[todo] += length[bits] + size
                k[todo] += run + 1
                ended = (size == 0) & (run != 15) | (k[todo] > 63)
                todo = todo[~ended]
            pos[live] = p
    return out


def _luminance(picture: Picture, scan: int) -> tuple[list[tuple[int, bytes, bytes]], int, int, int, int, int] | None:
    """(blocks of an MCU, MCUs across, MCUs down, first luminance block, its h, its v) of a scan with luminance in it."""
    chosen = picture.scans[scan][0]
    lead = picture.components[0]
    if lead not in chosen:
        return None
    across, down = (max(getattr(c, x) for c in picture.components) for x in "hv")
    if len(chosen) == 1:  # not interleaved: blocks of the component itself
        w, h = -(-picture.width * lead.h // (8 * across)), -(-picture.height * lead.v // (8 * down))
        return [(0, lead.dc, lead.ac)], w, h, 0, 1, 1
    blocks = [(i, c.dc, c.ac) for i, c in enumerate(chosen) for _ in range(c.h * c.v)]
    before = sum(c.h * c.v for c in chosen[: chosen.index(lead)])
    return blocks, -(-picture.width // (8 * across)), -(-picture.height // (8 * down)), before, lead.h, lead.v


def thumbnails(media: list[bytes | None]) -> list[tuple[list[tuple[int, int, np.ndarray]], str | None]]:
    """For each byte string: (width, height, DC-only luminance thumbnail) of its pictures, and what is wrong with it.

    Intervals of all pictures with the same tables are decoded in step; if one of them is broken, the pictures are
    decoded one by one, so that only the broken ones fail.
    """
    found: list[list] = [[] for _ in media]
    wrong: list[str | None] = [None] * len(media)
    jobs: dict[tuple, list] = {}
    for n, data in enumerate(media):
        try:
            if data is None:
                raise Malformed("null")
            for picture in parse_jpegs(data):
                scan = next((i for i in range(len(picture.scans)) if _luminance(picture, i)), None)
                if scan is None:
                    raise Malformed("no luminance")
                blocks, w, h, before, lh, lv = _luminance(picture, scan)
                _, begin, end, interval = picture.scans[scan]
                coded, starts = _unstuffed(np.frombuffer(data, np.uint8, end - begin, begin))
                mcus = np.full(len(starts), interval or w * h)
                mcus[-1] = w * h - (len(starts) - 1) * (interval or w * h)
                if mcus[-1] < 1 or mcus[-1] > (interval or w * h):
                    raise Malformed("restart markers")
                place = len(found[n])
                found[n].append((picture.width, picture.height, None))
                q = picture.quantiser.get(picture.components[0].quantiser, 1)
                jobs.setdefault((tuple(blocks), before, lh, lv), []).append((n, place, coded, starts, mcus, w, h, q))
        except Malformed as e:
            wrong[n] = str(e)

    def work(kind: tuple, part: list) -> None:
        blocks, before, lh, lv = kind
        offsets = np.cumsum([0, *(len(j[2]) for j in part)])
        starts = np.concatenate([j[3] + o for j, o in zip(part, offsets, strict=False)])
        mcus = np.concatenate([j[4] for j in part])
        dc = _decode_in_step(np.concatenate([j[2] for j in part]), starts, mcus, list(blocks))
        at = 0
        for n, place, _, own, counts, w, h, q in part:
            rows = dc[at : at + len(own)]
            at += len(own)
            flat = rows.reshape(-1, len(blocks)) if (counts == rows.shape[1]).all() else np.concatenate([r[:c] for r, c in zip(rows, counts, strict=True)])
            grid = flat[:, before : before + lh * lv].reshape(h, w, lv, lh).transpose(0, 2, 1, 3).reshape(h * lv, w * lh)
            samples = np.clip((grid * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
            found[n][place] = (*found[n][place][:2], samples)

    for kind, part in jobs.items():
        part = [j for j in part if wrong[j[0]] is None]
        if not part:
            continue
        try:
            work(kind, part)
        except Malformed:
            for j in part:
                try:
                    work(kind, [j])
                except Malformed as e:
                    wrong[j[0]] = str(e)
    return [([], w) if w else (f, None) for f, w in zip(found, wrong, strict=True)]


def _means(thumb: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """``thumb`` shrunk or stretched to rows x columns, as mean samples times 256 (whole numbers)."""
    for axis, n in ((0, rows), (1, columns)):
        size = thumb.shape[axis]
        cuts = np.arange(n) * size // n
        if size >= n:
            total = np.add.reduceat(thumb.astype(np.int64), cuts, axis=axis)
            count = np.diff(np.r_[cuts, size])
            thumb = total * (256 if axis == 0 else 1) // (count[:, None] if axis == 0 else count)
        else:
            thumb = np.take(thumb.astype(np.int64), cuts, axis=axis) * (256 if axis == 0 else 1)
    return thumb


def thumbnail_hashes(thumb: np.ndarray) -> tuple[str, str]:
    """(average hash, difference hash) of a thumbnail, 64 bits each in hex."""
    small = _means(thumb, 8, 8)
    average = np.packbits(small * small.size > small.sum()).tobytes().hex()
    wide = _means(thumb, 8, 9)
    return average, np.packbits(wide[:, 1:] > wide[:, :-1]).tobytes().hex()


def payload_of(text: str | None) -> bytes:
    """A text's UTF-8 bytes, with bytes 0 up to a positive multiple of ``ROW``."""
    data = (text or "").encode()
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def _strides(sizes: Iterable[int]) -> list[slice]:
    """Slices of neighbours of about ``STRIDE`` bytes."""
    out, start, held, n = [], 0, 0, 0
    for n, size in enumerate(sizes, 1):
        held += size
        if held >= STRIDE:
            out.append(slice(start, n))
            start, held = n, 0
    return [*out, slice(start, n)] if start < n else out


def stored(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with a binary column: each whole text as baseline JPEG. Null counts as empty; no shuffle; all other columns pass.

    Where ``df`` has a column ``out``, the new one's name has underscores added; so in ``media_features``.
    """

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        payloads = [payload_of(t.as_py()) for t in texts]
        return pa.array([m for s in _strides(map(len, payloads)) for m in write_jpegs(payloads[s])], pa.binary())

    return df.withColumn(free_name(df, out), of(F.col(f"`{text}`")))


_FEATURES = "width long, height long, pictures int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, average_hash string, difference_hash string, error string"


def media_features(df: DataFrame, media: str = "media", out: str = "features") -> DataFrame:
    """``df`` with a struct column of what the stored bytes hold.

    Dimensions are those of the pictures behind each other (largest width, sum of heights); the payload is the
    thumbnails' samples row by row, and the hashes are those of the whole thumbnail. A null or malformed value has an
    ``error`` and nulls elsewhere (its size and digest are kept); the other rows are not affected.
    """
    kind = pa.struct([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]]) for f in _FEATURES.split(", ")])

    def one(data: bytes | None, pictures: list, error: str | None) -> dict:
        row: dict = {"error": error}
        if data is not None:
            row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        if error:
            return row
        payload = b"".join(p[2].tobytes() for p in pictures)
        thumb = pictures[0][2] if len({p[2].shape[1] for p in pictures}) > 1 else np.concatenate([p[2] for p in pictures])
        average, difference = thumbnail_hashes(thumb)
        return row | {"width": max(p[0] for p in pictures), "height": sum(p[1] for p in pictures), "pictures": len(pictures), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "average_hash": average, "difference_hash": difference}

    @F.arrow_udf(_FEATURES)
    def of(values: pa.Array) -> pa.Array:
        data = [v.as_py() for v in values]
        return pa.array([one(d, *t) for s in _strides(len(d or b"") for d in data) for d, t in zip(data[s], thumbnails(data[s]), strict=True)], kind)

    return df.withColumn(free_name(df, out), of(F.col(f"`{media}`")))
