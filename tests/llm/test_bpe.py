"""Encoding, decoding and counting against the public library, and the transducer against whole-text merging."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import bpe as B
from tallyweave.llm import tokencount as C
from tallyweave.llm import vocabulary as V

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def hard_texts():
    rng = random.Random(7)
    pool = [chr(rng.randrange(0x20, 0x3000)) for _ in range(300)] + list("ΣΣİßàé́ \x85\x1c\x0b \n\t'sdmtrev AaBbCc123")
    fuzz = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)]
    long = ["a" * 3000, "abcab" * 1500, "é" * 2000, "!?" * 2500, "".join(rng.choice("aeinrst") for _ in range(8000))]
    return ["", " ", "I'll 've's", "<|endoftext|>x <|startoftext|> <|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "Ᲊ \U00016ea0 Ꟛ"] + long + fuzz


def test_encoding_and_decoding(spark):
    texts = hard_texts()
    library = Tokenizer.from_file(WORD)
    want = library.encode_batch(texts, add_special_tokens=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("IDS", F.lit(0))
    got = {r.doc_id: r.encoding for r in B.encoding_digests(df, WORD).collect()}
    for i, e in enumerate(want):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[i]) == (len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))), texts[i][:40]
    back = B.decoded(B.encoded(df.drop("IDS"), WORD), WORD).collect()
    assert all(r.ids == want[r.doc_id].ids and r.decoded == library.decode(want[r.doc_id].ids, skip_special_tokens=False) for r in back)


def test_every_code_point():
    library, v, memory = Tokenizer.from_file(WORD), V.parse(V.load(WORD)), {}
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 20_000):
        texts = [f"a{c}b {c}! {c}1{c}{c}\u0301" for c in points[start : start + 20_000]]
        for text, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert [i for ids in B.encode(text, v, memory) for i in ids] == e.ids, hex(ord(text[1]))


def test_stretches_do_not_show(monkeypatch):
    library, v = Tokenizer.from_file(WORD), V.parse(V.load(WORD))
    monkeypatch.setattr(B, "STRETCH", 7)
    monkeypatch.setattr(B, "STRIDE", 2)
    for text in hard_texts():
        assert [i for ids in B.encode(text, v, {}) for i in ids] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_transducer_is_exact_and_bounded(path):
    v = V.parse(V.load(path))
    rng = random.Random(1)
    for alphabet in ("ab", "aeinrst", "0", "!?.", "the "):
        symbols = [v.inner[ord(rng.choice(alphabet))] for _ in range(5000)]
        t, out, start = B.Transducer(v), [], 0
        while start < len(symbols):
            n = rng.randrange(1, 900)
            out += t.push(symbols[start : start + n])
            start += n
            assert len(t.held) <= 2 * t.room
        assert out + t.close() == [token for token, _ in B.merge(symbols, v)]


def test_lookahead_of_a_small_list():
    # (c, d) could take the end of what (b, c) needs, and so on along a chain of falling ranks
    assert V.sufficient_lookahead([]) == 1
    assert V.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 4


def test_byte_rendering():
    v = V.parse(V.load(BYTE))
    ids = Tokenizer.from_file(BYTE).encode("naïve 😀 text", add_special_tokens=False).ids
    d = B.Decoder(v, spaced=False)
    assert "".join(d.push([i]) for i in ids) + d.close() == "naïve 😀 text"


def test_token_counts(spark):
    texts = [*hard_texts(), None]
    library = Tokenizer.from_file(BYTE)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in C.with_token_counts(df, BYTE).collect()}
    assert all(got[i] == len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts))


def test_counts_do_not_depend_on_memory(monkeypatch):
    v = V.parse(V.load(BYTE))
    table, texts = C.MergeTable(v), hard_texts()
    whole = C.token_counts(texts, v, table, {})
    monkeypatch.setattr(C, "MEMORY", 50)
    monkeypatch.setattr(C, "STRIDE", 500)
    assert C.token_counts(texts, v, table, {}) == whole


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.encoding_digests(df, WORD).count() == 0 and C.with_token_counts(df, BYTE).count() == 0


def test_count_column_beside_one_of_that_name(spark):
    got = C.with_token_counts(spark.createDataFrame([("a b", "kept")], "text string, N_TOKENS string"), BYTE).first()
    assert (got.N_TOKENS, got.n_tokens_) == ("kept", 2)
