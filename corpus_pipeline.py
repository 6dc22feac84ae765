"""The corpus pipeline: stages over the documents table, each a call of one operator of petrichor.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from petrichor.llm.common import documents, written
from petrichor.llm.stages import decontaminate, identify_language, mix_sources, near_dedup, write_sequences

STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_sequences", write_sequences),
]

#: Language models, MinHash, SimHash and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
