"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chosen_path, conversation_repair, decontamination, hard_negatives, jaccard_join, knn_quality, language_id, line_dedup, piece_tokens, quality_rules, sharding, toxicity, warc
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted target is what labels.quality marks as good; whole words and their pairs have 2^20 buckets each."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = quality_rules.rate(table(spark, sf_dir, "documents"), trusted, whole=1 << 20)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.digest(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of two words, similarity 0.8 or more, as the contract has it."""
    return chosen_path.near_copies(table(spark, sf_dir, "documents"), width=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_jaccard_join": op2_jaccard_join, "op3_language_id": op3_language_id, "op4_warc": op4_warc, "op5_line_dedup": op5_line_dedup, "op6_quality_rules": op6_quality_rules, "op7_sharding": op7_sharding, "op8_quality_classifier": op8_quality_classifier, "op9_benchmark_decontamination": op9_benchmark_decontamination, "op10_sentencepiece": op10_sentencepiece, "op11_conversation_repair": op11_conversation_repair, "op12_hard_negatives": op12_hard_negatives, "op13_near_copies": op13_near_copies}
