"""The corpus pipeline: rules, exact copies, near copies, the mix, and tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. A
stage's result is written as Parquet and read again, so a lost executor costs no
more than the tasks it ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_bpe import encoded_documents
from tidemark.llm.common import staged, table
from tidemark.llm.exact_dedup import drop_exact_duplicates
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.near_dedup import drop_near_duplicates
from tidemark.llm.quality_rules import drop_low_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: The near copies, the mix and the tokens have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
