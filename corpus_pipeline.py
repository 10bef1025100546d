"""A training corpus from raw documents: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the columns of documents;
the last returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, linededup, mixing, quality, similar
from tallyweave.llm.queries import vocabulary_path
from tallyweave.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go.

    A null or empty text fails the base rule. Rows that repeat are judged alike, null keys like others; with no labels only the base rule
    counts. An empty table stays empty, further columns pass, whatever their names.
    """
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


#: Documents are less alike than pages of a web site: a line in over this share of comparable documents is boilerplate.
LINE_RATIO = 0.005
#: Fewer documents than this, of a source and across the sources of a language, may as well be near copies of each other.
SOURCE_MIN_DOCS, LINE_MIN_DOCS = 5, 20


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat go, first within a source's documents of a language, then over all sources of a language;
    every document stays, with its new number of characters.

    Null and empty texts stay as they are; documents without a source or language form groups of their own. Copies of a document count their lines once;
    of a line that goes, every repeat in a document goes. An empty table stays empty; further columns pass, whatever their names.
    """
    columns = docs.columns
    cell = F.to_json(F.struct("source", "lang"))
    cleaned = linededup.deduplicated(docs, cell, "text", LINE_RATIO, SOURCE_MIN_DOCS, copies_once=True).select(*columns)
    cleaned = linededup.deduplicated(cleaned, F.col("lang"), "text", LINE_RATIO, LINE_MIN_DOCS, copies_once=True)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays: five-word shingles, similarity 0.8 or more, smallest doc_id.

    Texts without words are copies of each other; null keys come last, equal keys by a digest of their text, exact repeats of a row leave one. An
    empty table stays empty; all columns pass, whatever their names.
    """
    return similar.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them: 0 to 3 times.

    Null, empty and blank texts have no words and are left out; a null source is one of its own, last in order. Rows that share key and size share
    their rounds. An empty table stays empty; all columns pass, whatever their names.
    """
    return mixing.resampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of each document; none for a null or empty text. Repeated rows are encoded each."""
    path = vocabulary_path("word_bpe_49k.json")
    return bpe.encoded(docs.select("doc_id", "source", "text"), path, "text", "ids").select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Learned rules, near-copies and BPE are not expressible in SQL. In tests/llm the operators of the stages are held against brute force or the public
#: library, and the stages as a whole against documents whose fate is planted.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
