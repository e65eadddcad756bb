"""The operators' queries over the documents table, with their production parameters, and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import alignment, bpe, chat, decontaminate, host_rules, language_id, line_dedup, near_dups, ranking, secrets, sharding, toxicity, weak_quality
from inkwell.llm.common import load


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(load(spark, sf_dir, "documents"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_host_rules(load(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(load(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.score_quality(load(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(load(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(load(spark, sf_dir, "documents")))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_lines(load(spark, sf_dir, "sale_lines"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(chat.with_probe(spark, load(spark, sf_dir, "conversations")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.digest(alignment.align(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_bpe": op2_bpe,
    "op3_near_dups": op3_near_dups,
    "op4_host_rules": op4_host_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_secrets": op10_secrets,
    "op11_ranking": op11_ranking,
    "op12_chat": op12_chat,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op4_host_rules": host_rules.ORACLE,
    "op11_ranking": ranking.ORACLE,
    "op12_chat": chat.ORACLE,
}
