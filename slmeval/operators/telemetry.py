"""Device telemetry in batch: counter deltas, CPU percent, memory usage, latest reading.

A CPU snapshot is ``(device_id, ts, counters ARRAY<BIGINT>)`` -- the first ``/proc/stat``
line without the word ``cpu``; idle is ``counters[3]`` (field 5 of the line, so iowait counts
as busy) and the total is the sum of all counters including guest time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_sum_long
from ..functions.metrics import cpu_percent, format_memory_available, format_memory_used, memory_used, percent_of
from .ordered import ordered_scan

IDLE_INDEX = 3  # 0-based position of idle once the leading "cpu" is dropped


def snapshot_totals(counters) -> tuple:
    """``(idle, total)`` of a counter array."""
    c = F.col(counters) if isinstance(counters, str) else counters
    return c.getItem(IDLE_INDEX).cast("long"), array_sum_long(c)


def counter_delta(
    snapshots: DataFrame,
    device_col: str = "device_id",
    ts_col: str = "ts",
    counters_col: str = "counters",
    tie_cols: Sequence[str] = (),
    pair_col: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Per device, in time order: ``d_total``, ``d_idle`` against the previous snapshot and
    ``cpu_pct = (100 * (d_total - d_idle)) div d_total``.

    NULL on a device's first snapshot; NULL when a counter went backwards (a reboot resets
    them) or ``d_total`` is 0. ``pair_col`` limits the comparison to snapshots with the same
    value of that column (the reference pairs two snapshots inside one reading).
    Runs on :func:`ordered_scan`: a device with most of the rows is still spread over tasks.
    """
    groups = [device_col] + ([pair_col] if pair_col else [])
    idle, total = snapshot_totals(counters_col)
    base = snapshots.withColumn("_idle", idle).withColumn("_total", total)
    s = ordered_scan(base, groups, [ts_col, *tie_cols], carry=["_idle", "_total"], cum_col=None,
                     num_partitions=num_partitions)
    d_total = F.col("_total") - F.col("prev__total")
    d_idle = F.col("_idle") - F.col("prev__idle")
    valid = (d_total >= 0) & (d_idle >= 0)
    return s.select(
        *snapshots.columns,
        F.when(valid, d_total).alias("d_total"),
        F.when(valid, d_idle).alias("d_idle"),
        F.when(valid, cpu_percent(d_total, d_idle)).alias("cpu_pct"),
    )


def memory_usage(gauges: DataFrame, total_col: str = "total_mb", available_col: str = "available_mb") -> DataFrame:
    """Adds used MB, used and available percent and the two report texts."""
    used = memory_used(total_col, available_col)
    return gauges.select(
        *gauges.columns,
        used.alias("used_mb"),
        percent_of(used, total_col).alias("used_pct"),
        percent_of(available_col, total_col).alias("available_pct"),
        format_memory_used(total_col, available_col).alias("used_text"),
        format_memory_available(total_col, available_col).alias("available_text"),
    )


def latest_reading(df: DataFrame, device_col: str, ts_col: str, value_cols: Sequence[str],
                   tie_cols: Sequence[str] | None = None) -> DataFrame:
    """The newest row per device (the reading that replaces the former one on screen).

    Of rows with the same time the one with the largest ``tie_cols`` (default: the values) is taken,
    so the result does not depend on the row order; a NULL time is older than any other.
    ``max_by`` is a partial + final aggregate: a device with most rows is combined map-side.
    """
    order = F.struct(F.col(ts_col), *[F.col(c) for c in (value_cols if tie_cols is None else tie_cols)])
    picked = df.groupBy(device_col).agg(F.max_by(F.struct(*[F.col(c) for c in [ts_col, *value_cols]]), order).alias("_m"))
    return picked.select(device_col, *[F.col(f"_m.{c}").alias(c) for c in [ts_col, *value_cols]])
