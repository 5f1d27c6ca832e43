"""The corpus pipeline: language ID, line dedup, near-copy removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept, read again from
Parquet; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuemesh.deploy import ship
from valuemesh.llm import decontam, jaccard_join, langid, line_dedup, packing
from valuemesh.llm.queries import BYTE_BPE, tokenizer_path
from valuemesh.llm.store import Scratch

#: Rows whose calibrated language score is lower are rejected, as are rows without a letter.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.drop_unidentified(docs, LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_duplicate_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op2_packing(docs, tokenizer_path(BYTE_BPE))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_copies", near_copies), ("decontamination", decontaminate), ("packing", pack)]

#: Tokenisation and the language model have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
