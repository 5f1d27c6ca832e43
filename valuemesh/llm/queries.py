"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from valuemesh.deploy import ship
from valuemesh.llm import decontam, jaccard_join, langid, line_dedup, metric_join, oracle, packing, pii, secrets, substring_dedup, token_counts

#: Vocabulary files of the public tokenizers.
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op1_substring_dedup(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op2_packing(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op3_langid(_table(spark, sf_dir, "documents"))


def op8_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.op8_embedding_join(_table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op9_ngram_jaccard(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op10_token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op4_line_dedup(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op5_pii(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op6_secrets(_table(spark, sf_dir, "documents"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op7_decontam(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_packing, op3_langid, op4_line_dedup, op5_pii, op6_secrets, op7_decontam, op8_embedding_join, op9_ngram_jaccard, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
