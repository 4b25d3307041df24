"""Registered queries of the operators in this package, each over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import conversations, decontaminate, exact, oracles, passages, pii, quality, ranked, suffixes, tokens, warc
from loomspark.llm.neardup import near_duplicates
from loomspark.llm.packing import pack_documents
from loomspark.llm.text import table
from loomspark.llm.toxicity import toxicity


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=5, percent=85)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"), length=50)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"), least_words=50, percent=80)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    return tokens.by_section(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, rule="first")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.digest(spark, f"{sf_dir}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_near_duplicates, op3_packing, op4_suffix_dedup, op5_personal_data, op6_quality_rules, op7_warc, op8_passages, op9_toxicity, op10_token_counts, op11_ranked_search, op12_conversation_repair, op13_exact_dedup)
}
SQL: dict[str, str] = {
    "op1_decontamination": oracles.DECONTAMINATION,
    "op2_near_duplicates": oracles.NEAR_DUPLICATES,
    "op4_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op6_quality_rules": quality.SQL,
    "op7_warc": warc.SQL,
    "op11_ranked_search": ranked.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_exact_dedup": exact.SQL,
}
