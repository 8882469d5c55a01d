"""Run results and loss logs as streams.

Run rows are appended to a CSV sink as they arrive, with a checkpoint, so a restarted job neither
loses nor repeats rows (the reference writes each row as it is done).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.logs import loss_records


def write_runs_stream(runs: DataFrame, path: str, checkpoint: str):
    """An append CSV sink with a header per file and Python ``csv`` quoting."""
    return (runs.writeStream.format("csv").outputMode("append").option("header", "true").option("escape", '"')
            .option("checkpointLocation", checkpoint).option("path", path))


def loss_records_stream(logs: DataFrame, run_col: str = "run_id", seq_col: str = "seq", logs_col: str = "logs") -> DataFrame:
    """Streaming ``(run_id, seq, kind, loss)``; numbering per series is done in batch."""
    return loss_records(logs, run_col, seq_col, logs_col)
