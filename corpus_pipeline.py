"""Corpus preparation: five stages, each on all rows that the one before it kept.

Every stage keeps the columns of its input, whatever their names, but the last, which returns pieces.  Null columns
other than ``text`` and ``doc_id`` decide nothing; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import langid, minhash, packing, quality, queries, substring
from orrery.llm.runtime import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter and texts in no recognised language (without labelled rows only the
    former two).  Texts of any length are read whole; repeated rows are judged alike, one by one."""
    return langid.filter_language(docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that fail a rule of the policy ``v1``: null and empty texts are too short.  Repeated rows are judged
    alike, one by one."""
    return quality.filter_quality(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: of its smallest doc_id (ties: of the rows with that doc_id the one
    with the smallest hash of all columns).  Rows with a null doc_id, and texts without words, stay."""
    return minhash.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of windows that a smaller doc_id has too (a null doc_id is the largest; equal ones spare each other).
    Every row stays, one that loses all words with an empty text; null texts stay null."""
    return substring.edit_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens and their places in sequences; a null or empty text is one piece of one token."""
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"), 4096)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", remove_repeats),
    ("best_fit_packing", pack_sequences),
]

#: A trained network and a subword tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
