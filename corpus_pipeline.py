"""A training corpus from raw documents: five stages, each written before the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import stages
from eventloom.session import stage

STAGES = [
    ("quality_rules", stages.keep_good),
    ("line_dedup", stages.drop_lines),
    ("near_dedup", stages.keep_first_copies),
    ("mixing", stages.mix),
    ("byte_bpe", stages.encode),
]

#: The isolation forest and the tokenizer cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
