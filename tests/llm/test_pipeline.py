"""The stages one after the other on small documents."""

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm.queries import QUERIES, vocabulary_path


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    texts = [[word() for _ in range(80)] for _ in range(150)]
    rows = [(i, "\n".join([" ".join(w[:40]), "a line of every page of this site", " ".join(w[40:])]), "en", f"s{i % 3}") for i, w in enumerate(texts)]
    rows += [(500 + i, rows[i][1], "en", "s1") for i in range(10)] + [(600 + i, "### " * 40 + rows[i][1], "en", "s0") for i in range(30)] + [(700, "short", "en", None), (701, None, "en", "s0")]
    folder = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(600 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = dict(P.STAGES)
    kept = steps["quality_rules"](spark, docs, sf_dir)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == set(range(150)) | set(range(500, 510))
    lines = steps["line_dedup"](spark, kept, sf_dir)
    rows = lines.collect()
    assert lines.columns == columns and len(rows) == 160 and not any("every page" in r.text for r in rows) and all(r.n_chars == len(r.text) for r in rows)
    one = steps["near_dedup"](spark, lines, sf_dir)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == set(range(150))
    mix = steps["mix_sources"](spark, one, sf_dir)
    assert mix.columns == columns and {r.doc_id for r in mix.collect()} <= set(range(150))
    ids = steps["encode"](spark, mix, sf_dir).first()
    text = mix.where(F.col("doc_id") == ids.doc_id).first().text
    assert ids.ids == Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def test_run_and_registration(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.count() > 0 and {r.n_tokens > 0 for r in out.select("n_tokens").collect()} == {True}
    assert [q for q in QUERIES if q.startswith("op")] == sorted((q for q in QUERIES if q.startswith("op")), key=lambda q: int(q[2:].split("_")[0]))
    assert len(P.STAGES) == 5 and "pipeline" in QUERIES


def test_lines_that_repeat_thinly_go(spark):
    """A line on one in ten documents of a language, spread over the sources, and one of a source on one in fifteen."""
    rows = [(i, f"own {i}\n" + ("everywhere" if i % 10 == 0 and i % 4 == 2 else "of it") + f" {'fr' if i % 4 == 2 else i}\nend {i}", "fr" if i % 4 == 2 else "en", f"s{i % 40}") for i in range(2000)]
    rows += [(5000 + i, f"text {i}\n" + ("a note of this source" if i % 15 == 0 else f"none {i}"), "en", "t") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r.text for r in P.line_dedup(spark, docs, "").collect()}
    repeated = ("everywhere fr", "of it fr", "a note of this source")
    assert got == {r[0]: "\n".join(x for x in r[1].split("\n") if x not in repeated) for r in rows}


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls in every column, empty and long texts, exact repeats, clashing names; then an empty table."""
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, text(60), "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None) for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \n\t", "en", "s0"), (None, text(50), None, None), (None, None, "en", "s1"), (103, text(20_000), "en", "s1")]
    rows += [rows[7]] * 3 + [(200, rows[8][1], "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumns({c: F.lit("x") for c in ("n_words", "_w", "_row", "size", "taken", "digest", "node", "n_lines", "_key", "host")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 0, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = df, {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "encode" or docs.columns == df.columns
        seen[name] = [r.doc_id for r in docs.collect()]
    assert sorted(seen["quality_rules"], key=str) == sorted([*range(60), None, 103, 7, 7, 7, 200], key=str)
    assert sorted(seen["line_dedup"], key=str) == sorted(seen["quality_rules"], key=str)
    assert sorted(seen["near_dedup"], key=str) == sorted([*range(60), None, 103], key=str)
    assert set(seen["encode"]) == set(seen["mix_sources"]) <= set(seen["near_dedup"])
    empty = df.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
