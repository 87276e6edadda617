"""The corpus pipeline: language, repeated lines, near duplicates, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; its result is written as Parquet to
the shared folder and reread as the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drawlake.llm import jaccard_join, language_id, line_dedup, mixing, packing
from drawlake.llm.common import documents, staged

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("mix", mixing.stage),
    ("pack", packing.stage),
]

#: The language model, the mixture's Newton rounds and the token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
