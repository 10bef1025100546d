"""Exact round trips, a general JPEG against a scalar decoder, and malformed input."""

import hashlib
import random
import zlib

import numpy as np

from tallyweave.llm import media as M

TEXTS = [None, "", "a", "b" * 63, "c" * 64, "c" * 65, "ÿ" * 5000, "\x00\x7f" * 300, "z" * (64 * 8191 + 5), "word " * 999]


def test_round_trip(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(chr(rng.randrange(1, 0x800)) for _ in range(rng.randrange(500))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, width int")
    rows = M.media_features(M.stored(df)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload, f = M.payload_of(texts[r.doc_id]), r.features
        assert len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == (texts[r.doc_id] or "").encode().rstrip(b"\0")
        assert (f.error, f.payload_bytes, f.payload_sha256) == (None, len(payload), hashlib.sha256(payload).hexdigest())
        assert f.tail_crc32 == zlib.crc32(payload[-64:]) and f.media_sha256 == hashlib.sha256(r.media).hexdigest() and f.media_bytes == len(r.media)
        assert f.width == 512 and f.height == len(payload) // 64 * 8 and f.pictures == -(-len(payload) // (64 * 8191))


def test_malformed_values_do_not_hurt_others(spark):
    good = M.write_jpegs([b"x" * 64])[0]
    values = [good, good[:-40], b"", b"\xff\xd8\xff\xd9", None, good[:30] + b"\xff" + good[31:], good.replace(b"\xff\xc0", b"\xff\xc2")]
    df = spark.createDataFrame(list(enumerate(map(lambda v: None if v is None else bytearray(v), values))), "i int, media binary")
    got = {r.i: r.features for r in M.media_features(df).collect()}
    assert got[0].error is None and all(got[i].error for i in (1, 2, 3, 4, 6))
    assert M.media_features(df.limit(0)).count() == 0


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]

    def data(self):
        self.bits += [1] * (-len(self.bits) % 8)
        out = bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))
        return out.replace(b"\xff", b"\xff\x00")


def general_jpeg(rng, width, height, h, v, interval):
    """A three-component JPEG with AC coefficients, and its luminance DC values."""
    dc_code = M._codes(M._DC_LENGTHS, M._DC_SYMBOLS)
    ac_symbols = (0x00, 0x01, 0x12, 0xF0, 0x03)
    ac_lengths = (0, 2, 0, 3) + (0,) * 12
    ac_code = M._codes(ac_lengths, ac_symbols)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    grid = np.zeros((down * v, across * h), int)
    parts, bits, last, done = [], Bits(), [0, 0, 0], 0

    def block(component, value):
        diff = value - last[component]
        last[component] = value
        size = abs(diff).bit_length()
        bits.put(*dc_code[size])
        bits.put(diff if diff >= 0 else diff + (1 << size) - 1, size)
        k = 1
        while k < 60 and rng.random() < 0.4:
            s = rng.choice(ac_symbols[1:])
            if k + (s >> 4) > 62:
                break
            bits.put(*ac_code[s])
            bits.put(rng.getrandbits(s & 15) if s & 15 else 0, s & 15)
            k += (s >> 4) + 1
        bits.put(*ac_code[0])

    for y in range(down):
        for x in range(across):
            if interval and done and done % interval == 0:
                parts += [bits.data(), bytes([0xFF, 0xD0 + (done // interval - 1) % 8])]
                bits, last = Bits(), [0, 0, 0]
            for j in range(v):
                for i in range(h):
                    grid[y * v + j, x * h + i] = value = rng.randrange(-60, 60)
                    block(0, value)
            block(1, rng.randrange(-9, 9))
            block(2, rng.randrange(-9, 9))
            done += 1
    parts.append(bits.data())
    frame = M.struct.pack(">BHHB", 8, height, width, 3) + bytes([1, h << 4 | v, 0, 2, 0x11, 1, 3, 0x11, 1])
    head = b"\xff\xd8" + M._segment(0xE0, b"JFIF\0") + M._segment(0xDB, b"\0" + bytes([16] + [3] * 63) + b"\1" + bytes([9] * 64)) + M._segment(0xC0, frame)
    head += M._segment(0xC4, bytes([0, *M._DC_LENGTHS, *M._DC_SYMBOLS])) + M._segment(0xC4, bytes([0x10, *ac_lengths, *ac_symbols]))
    head += (M._segment(0xDD, M.struct.pack(">H", interval)) if interval else b"") + M._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return head + b"".join(parts) + b"\xff\xd9", grid


def test_general_baseline_pictures():
    rng = random.Random(8)
    made = [general_jpeg(rng, w, h, *f, n) for w, h, f, n in ((40, 24, (1, 1), 0), (50, 33, (2, 2), 0), (64, 17, (2, 1), 3), (33, 90, (1, 2), 5))]
    for (data, grid), (pictures, error) in zip(made, M.thumbnails([d for d, _ in made]), strict=True):
        assert error is None and np.array_equal(pictures[0][2], np.clip((grid * 16 + 4) // 8 + 128, 0, 255))


def test_hashes_of_thumbnails():
    up = np.tile(np.arange(64, dtype=np.uint8), (16, 1))
    assert M.thumbnail_hashes(up)[1] == "f" * 16 and M.thumbnail_hashes(up[:, ::-1])[1] == "0" * 16
    assert M.thumbnail_hashes(np.full((1, 64), 7, np.uint8)) == ("0" * 16, "0" * 16)


def test_clashing_names_and_one_long_text(spark, monkeypatch):
    df = spark.createDataFrame([("ab" * 400_000, 1, 2), (None, 3, 4)], "text string, media int, FEATURES int")
    got = M.media_features(M.stored(df), "media_").select("text", "media", "FEATURES", "features_.*").collect()
    assert [(r.media, r.FEATURES, r.payload_bytes) for r in got] == [(1, 2, 800_000), (3, 4, 64)]
    payloads = [bytes(range(64)) * 40, b"x" * 64]
    whole = M.write_jpegs(payloads)
    monkeypatch.setattr(M, "CODED_ROWS", 7)
    assert M.write_jpegs(payloads) == whole
