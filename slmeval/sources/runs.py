"""Run-result tables: CSV with a header (``answer, ram_before, ram_after, cpu_usage,
inference_time``), one file set per label, written and read with Python ``csv`` quoting.

Quotes inside a field are doubled and fields with commas, quotes or line breaks are quoted; such
files are read by :mod:`slmeval.sources.split_csv`, many tasks a file, columns by name. Metric text that does not parse
(``NA``, empty) becomes NULL; ``nan`` becomes NaN; the ``answer`` text is kept as is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .split_csv import read_csv

# The run-result header of the reference and the older latency column name.
RUN_COLUMNS = ["answer", "ram_before", "ram_after", "cpu_usage", "inference_time"]
METRICS = ["ram_before", "ram_after", "cpu_usage", "inference_time"]
OLD_TIME_COLUMN = "latency"

RUN_SCHEMA = T.StructType(
    [T.StructField("answer", T.StringType())] + [T.StructField(m, T.DoubleType()) for m in METRICS]
)

_CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def normalise_time_column(df: DataFrame) -> DataFrame:
    """Use ``inference_time``; the older ``latency`` stands in where a table, or a row of tables
    that were united by name, has no other time."""
    if OLD_TIME_COLUMN not in df.columns:
        return df
    if "inference_time" not in df.columns:
        return df.withColumnRenamed(OLD_TIME_COLUMN, "inference_time")
    return df.withColumn("inference_time", F.coalesce("inference_time", OLD_TIME_COLUMN)).drop(OLD_TIME_COLUMN)


def typed_runs(df: DataFrame) -> DataFrame:
    """Metric columns as doubles (unparseable text -> NULL), answer as text."""
    out = normalise_time_column(df)
    cols = []
    for c in out.columns:
        if c in METRICS:
            cols.append(F.col(c).cast("string").try_cast("double").alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One run-result CSV (or folder of them), columns by name; large files are split among tasks, also
    with line breaks inside answers."""
    return typed_runs(read_csv(spark, path))


def read_labelled_runs(spark: SparkSession, paths: Mapping[str, str] | str, label_col: str = "label") -> DataFrame:
    """Many run tables as one long table with a ``label`` column.

    ``paths`` is either ``{label: path}`` (each read, tagged and unioned by name, missing
    columns NULL) or a folder with ``label=<name>`` sub-folders (partition discovery: a label
    filter then prunes folders).
    """
    if isinstance(paths, str):
        return typed_runs(read_csv(spark, paths, base=paths))
    out = None
    for label, path in paths.items():
        df = read_runs(spark, path).withColumn(label_col, F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_runs(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = "label") -> None:
    """Write run rows as CSV with a header; one folder per label when ``partition_by``."""
    w = df.write.mode(mode).options(**_CSV_OPTIONS).option("quoteAll", "false").option("nullValue", "")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.csv(path)
