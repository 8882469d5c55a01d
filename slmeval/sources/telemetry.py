"""Recorded device readings as text lines, batch or stream.

CPU: ``<ts> <device_id> cpu <n1> <n2> ...`` -- a timestamp, a device and the first
``/proc/stat`` line. Memory: ``<ts> <device_id> Mem: <total> <used> <free> <shared>
<buff/cache> <available>`` -- the ``Mem:`` row of ``free -m``; total is field 2 and available
field 7 of that row. Lines of any other kind are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WS = r"\s+"


def parse_counter_lines(lines: DataFrame, value_col: str = "value", ts_type: str = "timestamp") -> DataFrame:
    """``(device_id, ts, counters ARRAY<BIGINT>)`` from CPU lines (works on streams).
    ``ts_type='timestamp_ntz'`` keeps recorded wall-clock times without a time zone."""
    parts = F.split(F.trim(F.col(value_col)), _WS)
    rows = lines.select(parts.alias("_p")).filter(F.get(F.col("_p"), 2) == F.lit("cpu"))
    return rows.select(
        F.col("_p").getItem(1).alias("device_id"),
        F.col("_p").getItem(0).cast(ts_type).alias("ts"),
        F.transform(F.slice("_p", F.lit(4), F.greatest(F.size("_p") - 3, F.lit(0))), lambda x: x.cast("long")).alias("counters"),
    )


def parse_memory_lines(lines: DataFrame, value_col: str = "value", ts_type: str = "timestamp") -> DataFrame:
    """``(device_id, ts, total_mb, available_mb)`` from ``Mem:`` lines (works on streams)."""
    parts = F.split(F.trim(F.col(value_col)), _WS)
    rows = lines.select(parts.alias("_p")).filter(F.get(F.col("_p"), 2).rlike("^Mem:$"))
    field = lambda i: F.get(F.col("_p"), 2 + i - 1)  # noqa: E731  awk field i of the Mem: row
    return rows.select(
        F.col("_p").getItem(1).alias("device_id"),
        F.col("_p").getItem(0).cast(ts_type).alias("ts"),
        field(2).cast("long").alias("total_mb"),
        field(7).cast("long").alias("available_mb"),
    )


def read_counters(spark: SparkSession, path: str, stream: bool = False, ts_type: str = "timestamp", **options) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return parse_counter_lines(reader.options(**options).text(path), ts_type=ts_type)


def read_memory(spark: SparkSession, path: str, stream: bool = False, ts_type: str = "timestamp", **options) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return parse_memory_lines(reader.options(**options).text(path), ts_type=ts_type)


def format_counter_lines(snapshots: DataFrame, device_col: str = "device_id", ts_col: str = "ts",
                         counters_col: str = "counters") -> DataFrame:
    """The recorder's CPU line for each snapshot (inverse of ``parse_counter_lines``)."""
    return snapshots.select(F.concat_ws(
        " ", F.date_format(ts_col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col(device_col).cast("string"), F.lit("cpu"),
        F.array_join(F.col(counters_col).cast("array<string>"), " ")).alias("value"))


def format_memory_lines(gauges: DataFrame, device_col: str = "device_id", ts_col: str = "ts",
                        total_col: str = "total_mb", available_col: str = "available_mb") -> DataFrame:
    """The recorder's ``Mem:`` line (used, free, shared, buff/cache written as 0)."""
    zero = F.lit("0")
    return gauges.select(F.concat_ws(
        " ", F.date_format(ts_col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col(device_col).cast("string"), F.lit("Mem:"),
        F.col(total_col).cast("string"), zero, zero, zero, zero, F.col(available_col).cast("string")).alias("value"))
