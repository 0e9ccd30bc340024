"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from alertlake.llm import (
    decontaminate, language, lm, mixing, paragraphs, quality, repair, simhash, suffixes, tokens, toxicity, trie, urls)
from alertlake.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair; nulls count as one space, an empty table gives no rows."""
    return repair.Repair(repair.damage(table(spark, sf_dir, "conversations")), copies="copies").report()


def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids with end id 2, packed, read back; a null or empty text is its end id, no table no rows."""
    return tokens.store_tokens(
        table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of rebuilt conversations; nulls are empty, rows without id left out, an empty table gives no rows."""
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_benchmark_decontamination, op3_simhash_dedup, op4_source_mixing, op5_quality_rules,
        op6_lm_scoring, op7_url_filter, op8_suffix_dedup, op9_language_id, op10_toxicity, op11_conversation_repair, op12_token_output,
        op13_prefix_trie)
}
ORACLES = {
    "op2_benchmark_decontamination": decontaminate.ORACLE, "op4_source_mixing": mixing.ORACLE,
    "op11_conversation_repair": repair.ORACLE, "op13_prefix_trie": trie.ORACLE}
