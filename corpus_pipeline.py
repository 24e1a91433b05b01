"""Cleaning of a training corpus: toxicity, line dedup, near dedup, decontamination, encoding.

Each stage reads what the one before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filetide.llm import decontaminate, pieces, superminhash, templates, toxicity
from filetide.llm.common import stored, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", templates.stage),
    ("near dedup", superminhash.stage),
    ("decontamination", decontaminate.stage),
    ("encoding", pieces.stage),
]
# Learned weights and tokenizer files have no form in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
