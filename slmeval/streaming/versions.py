"""Tables kept as a folder of versions, one per micro-batch (``v<batch id>``).

A version is complete when Spark has committed it (its ``_SUCCESS`` file). A crash in mid-write leaves
the versions before it untouched, and the replayed micro-batch writes its version anew.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, table_path: str) -> list[int]:
    """Complete versions, ascending; any error but a missing table folder is raised."""
    path, fs = folder(spark, table_path)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        m = re.fullmatch(r"v(\d+)", status.getPath().getName())
        if m and fs.exists(folder(spark, f"{status.getPath().toString()}/_SUCCESS")[0]):
            found.append(int(m[1]))
    return sorted(found)


def read_versions(spark: SparkSession, table_path: str, which: list[int]) -> DataFrame:
    """The rows of all versions ``which`` (at least one)."""
    if not which:
        raise FileNotFoundError(f"no complete version below {table_path}")
    return spark.read.parquet(*[f"{table_path}/v{v}" for v in which])


def before(spark: SparkSession, table_path: str, epoch_id: int) -> DataFrame | None:
    """The newest complete version older than a micro-batch; None for the first one."""
    older = [v for v in versions(spark, table_path) if v < epoch_id]
    return read_versions(spark, table_path, older[-1:]) if older else None


def write_version(df: DataFrame, table_path: str, epoch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{table_path}/v{epoch_id}")


def drop_older(spark: SparkSession, table_path: str, epoch_id: int) -> None:
    """Delete the versions older than the one before ``epoch_id``, which stays for its readers."""
    for v in [v for v in versions(spark, table_path) if v < epoch_id][:-1]:
        path, fs = folder(spark, f"{table_path}/v{v}")
        fs.delete(path, True)
