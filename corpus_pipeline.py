"""Corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes what the one before kept, written as Parquet and read again.
Language identification drops texts without a language; exact and near copies
leave one document of each group; mixing repeats or leaves out documents so the
sources meet their target weights; packing turns the rest into pieces of
sequences.  No stage is expressible in SQL as a whole, so there is no oracle
for the pipeline; each operator is tested by itself and the stages in
``tests/llm``.

Results for odd input, in every stage: an empty table gives an empty table with
the stage's columns; other columns, whatever their names, are carried along by
all stages but the last; rows that share an id are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import exact_dedup, jaccard, language, mixing, packing
from lodestar.llm.base import read, store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter, or lie equally near two
    languages.  A null id or lang is only not learned from; without any row to
    learn from, all rows go."""
    return language.drop_unidentified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts (null is empty) the row with the largest id; a null id
    loses to any other, of equal ids the last row stays."""
    return exact_dedup.drop_copies(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the document with the smallest id; rows without a
    word or with a null id stay."""
    return jaccard.one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents towards their source's target; a null source
    is a source, a text without words weighs nothing and is kept as it is only
    where its source's share is whole."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence; a null or empty text is its end id alone.
    Its workers share the executors with what the stages before have left there,
    so they hold less than packing by itself may."""
    return packing.pack(docs, chunk=1 << 19).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
