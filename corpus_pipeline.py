"""Training-data pipeline over ``documents``: each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimscan.llm import decontaminate, language_id, minhash_dedup, packing, quality_rules
from claimscan.llm._work import stash

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("language_id", language_id.stage),
    ("minhash_dedup", minhash_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("packing", packing.stage),
]

#: The stages use learned models, hashing and a tokenizer, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
