"""Stages that turn ``documents`` into packed training sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm import stages
from reviewloom.llm.common import table
from reviewloom.sources.files import shared_folder

# SQL has neither the fingerprints nor the tokenizer. tests/llm holds the operators, and
# which documents the near-duplicate stage keeps, to plain versions.
ORACLE_SQL = None

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("personal_data", stages.personal_data),
    ("packing", stages.packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
