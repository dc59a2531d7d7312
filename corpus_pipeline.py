"""The corpus pipeline: stages over ``documents``, each written and read again.

Language ID drops texts without a known language, MinHash near-dedup keeps one document of
each group, decontamination drops documents that hold a benchmark item, mixing
takes documents as often as their source's target asks, and sharding places the
rows along a Hilbert curve.  Every stage works on all rows that the one before kept.

Defined results: documents whose text is null or has no letter go at the first stage;
rows without a doc_id are kept by near-dedup and mixed like others; repeated rows of a
kept document stay with it, rows that repeat a doc_id with another text are judged
by their own text; a null source is the last source; columns may have any names (the
last stage replaces those named like its own: size, text_crc32, law, shard, slot,
grown_shard, hilbert); an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm import decontamination, language, minhash, mixing, sharding
from meridian.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontamination.clean_only(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.hilbert_shards(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Language ID and MinHash can't be written in SQL; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
