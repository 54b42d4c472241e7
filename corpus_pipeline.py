"""From raw documents to packed training sequences; each stage writes Parquet for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievestone.llm import decontamination, language_id, line_dedup, packing, simhash_dedup
from sievestone.session import materialize

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("decontamination", decontamination.stage),
    ("packing", packing.stage),
]

#: The language model and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
