"""Corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`. Rows are judged one
by one, so a missing or repeated doc_id neither saves a row nor takes another along. An empty table
gives an empty result; columns besides doc_id, text and lang pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, exact_dedup, language, packing, simhash
from textloom.llm.queries import table, vocabulary
from textloom.llm.scratch import clear, scope, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The predicted language takes the place of `lang`; documents without one (null texts, no letters) go."""
    return language.with_language(docs, language.fit(docs, language.learnable()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null equals empty) the row with the largest doc_id stays, of rows that repeat it one."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays, of rows that repeat it one."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: at least one word in twenty is hit. The others keep their texts."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in sequences of 4096 tokens."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("packing", pack)]

#: The language model, fingerprint hashes and the tokenizer can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written on its way is deleted once its result is stored."""
    docs = table(spark, sf_dir, "documents")
    done: list[str] = []
    for name, stage in STAGES:
        with scope() as made:
            docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, only=frozenset(done + made[:-1]))
        done = made[-1:]
    return docs
