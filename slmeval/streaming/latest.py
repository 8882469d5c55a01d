"""The latest reading per device, kept current as readings stream in.

A streaming aggregate (``max_by`` per device) in update mode; ``write_latest`` merges each
micro-batch's changed devices with ``foreachBatch`` (file sinks take only append output), which
is the on-screen "rewrite the three lines" of the reference.

A micro-batch writes only the devices that it changes (``delta``); every ``compact_every`` micro-batches
the whole table is merged into a new ``base``. Both are folders of versions, complete when Spark has committed
them (:mod:`slmeval.streaming.versions`). Readers merge the newest complete base with the complete deltas
after it. A crash in mid-write leaves all of those untouched, and the replayed micro-batch writes its delta
anew; a merge that did not end is left to the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.telemetry import latest_reading
from . import versions as vs


def latest_reading_stream(readings: DataFrame, device_col: str, ts_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Newest reading of each device so far (update mode)."""
    return latest_reading(readings, device_col, ts_col, value_cols)


def _merged(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The rows of the newest base and of the deltas after it."""
    bases = vs.versions(spark, f"{table_path}/base")[-1:]
    deltas = [v for v in vs.versions(spark, f"{table_path}/delta") if not bases or v > bases[0]]
    parts = [f"{table_path}/base/v{v}" for v in bases] + [f"{table_path}/delta/v{v}" for v in deltas]
    return spark.read.parquet(*parts) if parts else None


def read_latest(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest reading of each device of the micro-batches written so far: one aggregation over the
    base and the deltas. The first two columns are the device and its time."""
    rows = _merged(spark, table_path)
    if rows is None:
        raise FileNotFoundError(f"no complete version below {table_path}")
    device_col, ts_col, *values = rows.columns
    return latest_reading(rows, device_col, ts_col, values)


def write_latest(latest: DataFrame, table_path: str, checkpoint: str, device_col: str, ts_col: str, compact_every: int = 16):
    """A writer that keeps ``table_path`` equal to the newest reading of each device."""
    values = [c for c in latest.columns if c not in (device_col, ts_col)]

    def merge(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        vs.write_version(batch.select(device_col, ts_col, *values), f"{table_path}/delta", epoch_id)
        if (epoch_id + 1) % compact_every:
            return
        old = [v for v in vs.versions(spark, f"{table_path}/base") if v < epoch_id]
        # from the base before, also where a replay finds one of its own
        rows = vs.read_versions(spark, f"{table_path}/delta", [
            v for v in vs.versions(spark, f"{table_path}/delta") if v <= epoch_id and (not old or v > old[-1])])
        if old:
            rows = rows.unionByName(vs.read_versions(spark, f"{table_path}/base", old[-1:]))
        vs.write_version(latest_reading(rows, device_col, ts_col, values), f"{table_path}/base", epoch_id)
        vs.drop_older(spark, f"{table_path}/base", epoch_id)
        if old:  # what the base before holds; the deltas after it stay for its readers
            vs.drop_older(spark, f"{table_path}/delta", old[-1] + 1)

    return latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge)
