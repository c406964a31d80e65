"""A corpus from raw documents to packed sequences, as stages that are each written before the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postsieve.llm import jaccard, lines, mixing, packing, quality
from postsieve.llm.common import reach_package, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then the documents that the rules reject."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line that several documents hold stays in the first of them."""
    return lines.dedup_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near-duplicates: five words, similarity 0.8."""
    reach_package(spark)
    return jaccard.keep_one(docs, width=5, num=4, den=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources are mixed to their target weights."""
    reach_package(spark)
    return mixing.in_mixed_order(docs)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's token ids stands in sequences of 2048, which follow the order the documents come in."""
    reach_package(spark)
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=ranks, in_order=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mix", source_mix),
    ("best_fit_pack", best_fit_pack),
]

#: Tokenizing, scheduling and packing have no SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is stored and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
