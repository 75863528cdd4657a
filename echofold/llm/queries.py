"""The registered queries of this subpackage, and SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from echofold.llm import bpe, language, line_dedup, mixing, neighbours, simhash, spotsigs, token_counts, toxicity, url_filter
from echofold.llm.common import table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
COUNT_VOCABULARY = "word_bpe_49k.json"
COUNT_LIMIT = 2048


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_VOCABULARY), COUNT_LIMIT)


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_language": op3_language,
    "op4_url_filter": op4_url_filter,
    "op5_simhash": op5_simhash,
    "op6_neighbours": op6_neighbours,
    "op7_token_counts": op7_token_counts,
    "op8_spotsigs": op8_spotsigs,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
}
