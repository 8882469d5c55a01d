"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, reliable_checkpoint, scratch_path, ship_package

__all__ = ["prepare", "fresh_names", "put", "read_table", "word_count", "WORD", "SPACES", "HAS_WORD",
           "reliable_checkpoint", "scratch_path", "slices_by_size", "arrow_slices", "partitions"]

# A word is a run of characters other than the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder from the session (a local one only in local mode) and the package on
    the executors' Python path."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names for intermediate results that no column of ``df`` has (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        name = f"_llm_{s}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns; a column of ``df`` with the same name (case ignored) is replaced."""
    new = {k.lower() for k in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    return df.select(*kept, *[v.alias(k) for k, v in columns.items()])


def word_count(text: Column) -> Column:
    """Number of words (0 for null), as BIGINT."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_slices(column: pa.Array, limit: int) -> Iterable[tuple[int, int]]:
    """(start, end) ranges of an Arrow text or binary column of about ``limit`` bytes each, so that
    a task's memory does not follow the size of the batches it is sent; a longer value stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, end
        start = end


def slices_by_size(texts: list, limit: int) -> Iterable[tuple[int, int]]:
    """(start, end) ranges of ``texts`` of about ``limit`` characters; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
