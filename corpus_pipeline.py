"""Corpus pipeline: from the documents table to binary token ids.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and
returns a table that is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slopecast.llm import language, pfair, similar, templates, tokens
from slopecast.llm.common import load_table, settle
from slopecast.llm.queries import language_rows, word_vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no determined language; null languages are filled with the predicted one."""
    return language.of_known_language(docs, language_rows())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 or more of their five-word shingles; candidates by Golay keys of SimHashes,
    those beyond two bits by min-hash bands), the document with the least id stays."""
    return similar.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return templates.without_contaminated(docs, load_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Read the sources in their target shares until each was read once: every document stays, those
    of sources above their natural share come again in later epochs."""
    return pfair.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary id files in document order, and each document's place in them; a repeat has its own row."""
    return tokens.token_table(docs, word_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, models and token ids have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
