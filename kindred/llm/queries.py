"""The registered query of each operator: production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_pairs, decontaminate, jaccard, language, licenses, order_minhash, quality, ranked
from . import secrets_scan, shards, substrings, urls

#: Rank file of the tokenizer; another path may be given to the operator.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The two tokenizers that are aligned.
TOKENS_A, TOKENS_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_report(table(spark, sf_dir, "pages"))


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.corpus_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op4_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secret_report(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_report(table(spark, sf_dir, "documents"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_report(table(spark, sf_dir, "documents"), SHARDS)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_report(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.encode_and_decode(table(spark, sf_dir, "documents"), byte_pairs.vocabulary(spark, RANKS))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_report(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(spark, table(spark, sf_dir, "documents"), TOKENS_A, TOKENS_B)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {"op11_substring_dedup": substrings.DEDUP_SQL, "op13_ranked_search": ranked.SEARCH_SQL}
