"""Memory usage from a stream of gauges: stateless, the batch expressions unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.telemetry import memory_usage


def memory_usage_stream(gauges: DataFrame, total_col: str = "total_mb", available_col: str = "available_mb") -> DataFrame:
    return memory_usage(gauges, total_col, available_col)
