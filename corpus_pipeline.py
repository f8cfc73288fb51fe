"""Corpus pipeline: language ID, exact deduplication, SimHash near-deduplication, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the
last return the columns of ``docs``, extra ones included, and keep repeated and missing ids apart by the place
of their row. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fitloom.llm import exact_dedup, language, packing, wide_simhash
from fitloom.llm.common import keep_only, read, stable_row, stored

TOKENIZER = "byte_bpe_50k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without a letter."""
    return language.identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the smallest doc_id."""
    return keep_only(docs, exact_dedup.exact_groups(docs, stable_row(docs)).filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates keep the row with the smallest doc_id: five-word shingles, a similarity of
    0.8 or more as 256 bits tell it. Texts without words are one group; missing ids are the largest; ties
    go to the row that stands first."""
    return keep_only(docs, wide_simhash.near_copies(docs, row=stable_row(docs)).filter("kept"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("packing", packing_stage),
]

# Fingerprints, parses and subword ids are beyond SQL; the tests run all stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
