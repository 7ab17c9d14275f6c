"""Corpus pipeline: language ID, n-gram Jaccard join, PII, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, ngram_join, packing, pii
from tessera.llm.common import read, release, work_table, written

STAGES = [
    ("language_id", langid.stage),
    ("near_duplicates", ngram_join.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: Compression, metric joins and packing plans are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each reading what the one before it wrote; when a stage's result is stored,
    its work tables and the stage before it are deleted."""
    docs, mark = read(spark, sf_dir, "documents"), written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = work_table(docs, f"pipeline-{name}")
            release(spark, mark, keep_last=True)
    return docs
