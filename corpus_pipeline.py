"""The corpus pipeline: language ID, line dedup, document near-dedup, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that ``run`` writes as
Parquet, in the shared folder of ``spark.checkpoint.dir``, and reads again as the next stage's
documents. All stages but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slmeval.llm import pipeline_stages as stages
from slmeval.llm.common import prepare, read_table, scratch_path

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("mix_sources", stages.mix_sources),
    ("encode", stages.encode),
]

# SQL can express neither compression, MinHash candidates nor BPE merges: tests/llm compares the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
