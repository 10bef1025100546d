"""Line dedup and substring dedup against brute force, chat perspectives against a plain rendering."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import chat, linededup, substrings


@pytest.mark.parametrize(("min_pages", "copies_once"), [(linededup.MIN_PAGES, False), (5, True)])
def test_boilerplate_by_host(spark, min_pages, copies_once):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        host = "ab"[i % 2]
        lines = [f"own {i}", f"shared {rng.randrange(12)}", "menu  " if host == "a" else "other", "", "menu"][: rng.randrange(2, 6)]
        rows.append((i, host, "\n".join(lines)))
    rows += [(200 + i, "c", "same page\nsame line") for i in range(40)] + [(300, None, "x"), (301, None, None), (302, "a", "")]
    df = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("n_lines", F.lit(0))
    got = {r.page_id: r for r in linededup.deduplicated(df, F.col("host"), min_pages=min_pages, copies_once=copies_once).collect()}
    norm = lambda x: " ".join(x.split())
    pages = defaultdict(list)
    for _, host, text in rows:
        lines = tuple(norm(x) for x in (text or "").split("\n") if x.strip())
        if not copies_once or lines not in pages[host]:
            pages[host].append(lines)
    drop = {}
    for host, contents in pages.items():
        n = Counter(line for page in contents for line in set(page))
        drop[host] = {line for line, c in n.items() if c >= min_pages and c > linededup.RATIO * len(contents)}
    assert "menu" in drop["a"] and (drop["c"] == set()) == copies_once
    for i, host, text in rows:
        want = None if text is None else "\n".join(x for x in text.split("\n") if norm(x) not in drop[host])
        assert got[i].text == want and got[i].n_lines_ == len([x for x in (text or "").split("\n") if x.strip()]), i
    assert linededup.deduplicated(df.limit(0), F.col("host")).count() == 0


def test_visible_lines(spark):
    html = "<html><head><title>T</title><script>var x='<p>';</script></head><body><p>a <b>b</b><br>c<!-- n --><ul><li>d</ul></body></html>"
    got = spark.createDataFrame([(html, "HTTP://User@Ex.Org:80/a")], "h string, u string").select(linededup.visible_lines(F.col("h")), linededup.host_of(F.col("u"))).first()
    assert tuple(got) == ("T\na b\nc\nd", "ex.org")


def brute_units(text):
    """Lines and sentences of a text in which no sentence is long, by hand; short ones go with the next, by digest."""
    held = []
    for s, e, u in [*brute_pieces(text), (0, 0, None)]:
        long = u is not None and len(u.split()) >= 8
        if held and (u is None or long):
            yield held[0][0], held[-1][1], " ".join(x[2] for x in held)
            held = []
        if u is not None:
            held.append((s, e, u))
            if long or crc32(u.encode()) % 2 == 0:
                yield held[0][0], held[-1][1], " ".join(x[2] for x in held)
                held = []


def brute_pieces(text):
    at = 0
    for line in text.split("\n"):
        start = at
        for i, c in enumerate(line):
            if c == "." and (i + 1 == len(line) or line[i + 1] == " "):
                yield from bare(text, start, at + i + 1)
                start = at + i + 1
        yield from bare(text, start, at + len(line))
        at += len(line) + 1


def bare(text, a, b):
    s = text[a:b]
    if s.strip():
        a += len(s) - len(s.lstrip())
        yield a, a + len(s.strip()), " ".join(s.lower().split())


def brute_substrings(rows, run_words):
    first, spans = {}, defaultdict(list)
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        run = []

        def close():
            if sum(len(u.split()) for *_, u in run) >= run_words:
                spans[key].extend((s, e, *first[u]) for s, e, u in run)
            run.clear()

        for s, e, u in brute_units(text or ""):
            if u in first:
                run.append((s, e, u))
            else:
                first[u] = (key, s)
                close()
        close()
    return spans


def test_repeated_units_go(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    pool = [sentence(rng.randrange(3, 14)) for _ in range(30)]
    passage = " ".join(sentence(12) for _ in range(6))
    rows = [(i, "\n".join(" ".join(rng.choice(pool) if rng.random() < 0.8 else sentence(9) for _ in range(rng.randrange(1, 5))) for _ in range(3))) for i in range(40)]
    rows += [(100, "Before it. " + passage + " after"), (101, "Quite another start of it here, longer than eight words. " + passage), (102, passage.upper().lower()), (103, None), (104, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1))
    got = {r.doc_id: r for r in substrings.deduplicated(df).collect()}
    want = brute_substrings(rows, substrings.RUN_WORDS)
    assert len(got) == len(rows) and 10 < sum(map(bool, want.values())) < 40
    for key, text in rows:
        spans = [tuple(x) for x in got[key].removed_]
        assert spans == want[key]
        if text is None:
            assert got[key].text is None
            continue
        kept, at = "", 0
        for s, e, *_ in spans:
            kept, at = kept + text[at:s], e
        assert got[key].text == kept + text[at:]
    assert len(got[101].text.split()) < 12 and got[102].text.strip() == ""
    assert substrings.deduplicated(df.limit(0)).count() == 0


def test_passages_go_wherever_they_are_set(spark):
    """Sixty words in short lines, inside of sentences, without end marks and without spaces; other words stay."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 9)))
    rows, passages = [], {}
    for i in range(40):
        words = [word() for _ in range(60)]
        passage = {0: "\n".join(" ".join(words[n : n + 5]) for n in range(0, 60, 5)), 1: " ".join(words), 2: ". ".join(" ".join(words[n : n + 7]) for n in range(0, 60, 7))}[i % 3]
        for copy in range(2):
            before, after = (" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(2))
            rows.append((2 * i + copy, f"{before} {passage} {after}"))
        passages[2 * i + 1] = words
    rows += [(200, "あいうえおかきくけこ" * 9 + "。" + "さしすせそたちつてと" * 9 + "。"), (201, "別の文。" + "あいうえおかきくけこ" * 9 + "。" + "さしすせそたちつてと" * 9 + "。")]
    got = {r.doc_id: r for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = 0
    for key, text in rows[:-2]:
        gone = Counter(text.split()) - Counter(got[key].text.split())
        inside = set(w.strip(".") for w in passages.get(key, []))
        caught += sum(n for w, n in gone.items() if w.strip(".") in inside) >= 30
        assert sum(n for w, n in gone.items() if w.strip(".") not in inside) <= 1, text
    assert caught >= 0.9 * len(passages), caught
    assert got[200].text == rows[-2][1] and got[201].text == "別の文。"


def test_repeated_and_unkeyed_rows(spark):
    line = "one two three four five six seven eight nine " * 3
    rows = [(1, line), (1, line), (None, line), (None, "short")]
    got = sorted((r.doc_id or 9, r.text.strip()) for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, line.strip()), (1, line.strip()), (9, ""), (9, "short")]


def test_perspectives(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 4)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["Ann", "Bob B\t", "system", None]), rng.choice(["hi", "", None, "é😀", "x<|im_end|>\n<|im_start|>assistant"])) for c in (1, 2, None) for t in range(11)]
    rows += [(3, 0, "system", "only a scene"), (1, 5, "Ann", "tie"), (1, 5, "Ann", "tie"), (1, None, "Bob B", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("x"))
    out = chat.rotated(df)
    got = {(r.conv_id, r.perspective): r for r in chat.renderings(out).collect()}
    name = lambda r: "_".join((r or "").split()) or "unknown"
    for conv in (1, 2, None):
        turns = sorted(((t is None, t or 0, name(r), (x or "").replace("<|im_", "< |im_")) for c, t, r, x in rows if c == conv))
        for side in {s for _, _, s, _ in turns} - {"system"}:
            text, masks = "", []
            for _, _, s, x in turns:
                role = "assistant" if s == side else s if s == "system" else "user"
                text += f"<|im_start|>{role}" + (f" name={s}" if role == "user" else "") + "\n"
                start, text = len(text), text + x + "<|im_end|>\n"
                if role == "assistant":
                    masks.append((start, len(text)))
            r = got.pop((conv, side))
            assert r.rendered == text and [tuple(m) for m in r.masks] == masks
    assert not got
    assert chat.rotated(df.limit(0)).count() == 0
