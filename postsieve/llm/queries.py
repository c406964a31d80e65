"""The operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postsieve.llm import alignment, byte_bpe, gnat, jaccard, language_model, lines, mixing, packing, quality, secret_scan, tokens, toxicity, vectors
from postsieve.llm.common import reach_package
from postsieve.llm.oracles import JACCARD_JOIN, LINE_DEDUP, NEAR_VECTORS, QUALITY_RULES, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_report(_documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, sf_dir))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_documents(spark, sf_dir))


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ranks=ranks)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnat.code_report(_table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_ids": op3_token_ids,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_lm_score": op8_lm_score,
    "op9_best_fit_pack": op9_best_fit_pack,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {
    "op1_ngram_jaccard_join": JACCARD_JOIN,
    "op5_quality_rules": QUALITY_RULES,
    "op6_embedding_near_dedup": NEAR_VECTORS,
    "op10_line_dedup": LINE_DEDUP,
    "op11_vector_codes": vector_codes(),
}
