"""The queries of this subpackage with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, clustering, common, decontamination, divergence, language, packing, quality, simhash, substring, suffixes, token_counts, toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(common.documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so every text is counted here."""
    return token_counts.token_counts(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), common.shared_dir(spark, "token-cache"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removals(common.documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.graded(common.documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(common.documents(spark, sf_dir))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.audited(chat.with_planted(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op3_suffix_dedup": op3_suffix_dedup, "op4_simhash": op4_simhash, "op2_token_counts": op2_token_counts, "op5_toxicity": op5_toxicity, "op6_nearest_neighbours": op6_nearest_neighbours, "op7_packing": op7_packing, "op8_quality": op8_quality, "op9_decontamination": op9_decontamination, "op10_language_id": op10_language_id, "op11_source_divergence": op11_source_divergence, "op12_chat_formatting": op12_chat_formatting, "op13_centroid_clustering": op13_centroid_clustering}
ORACLES: dict[str, str] = {"op1_substring_dedup": substring.SQL, "op3_suffix_dedup": suffixes.SQL, "op9_decontamination": decontamination.SQL, "op11_source_divergence": divergence.SQL, "op12_chat_formatting": chat.SQL, "op13_centroid_clustering": clustering.SQL}
