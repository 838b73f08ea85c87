"""Corpus preparation: language, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept.
All but the last return the columns of ``docs``; the last returns one row of token facts per
document.  A stage's rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import byte_pairs, decontaminate, jaccard, language, secrets_scan
from kindred.llm.common import stored
from kindred.llm.queries import RANKS

#: Near duplicates: five words and a similarity of 0.8, as in decontamination.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without letters go."""
    return language.keep_known(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked documents."""
    return jaccard.keep_first(docs, NEAR_WORDS, NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars counted again."""
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return secrets_scan.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the token ids and of the bytes they decode to."""
    return byte_pairs.encode_and_decode(docs, byte_pairs.vocabulary(spark, RANKS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("byte_level_bpe", tokens),
]

#: No SQL: the stages need trained tables, set joins and a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
