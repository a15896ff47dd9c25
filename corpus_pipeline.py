"""From raw documents to token ids: five stages, each written as Parquet and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.  All but the last
return the columns of ``docs``; a changed text brings its ``n_chars`` along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinetable.llm import bpe, decontamination, near_copies, quality, repeats
from kinetable.llm.common import table, written


#: The shortest passage that counts as a repeat, in words.
PASSAGE_WORDS = 51


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash by multi-index hashing, links verified by five-word shingles."""
    return near_copies.dedup(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of over 50 words that occur more than once are cut out; every document stays."""
    return repeats.cleaned(docs, words=PASSAGE_WORDS)


def benchmark_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; every document stays."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to."""
    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_filter),
    ("simhash_dedup", near_dedup),
    ("suffix_dedup", repeat_removal),
    ("decontamination", benchmark_removal),
    ("bpe", tokenization),
]

#: No SQL for the classifier and the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
