"""Trainer log records -> loss series (the ``on_log`` callback as a table operator).

A log record is ``(run_id, seq, logs MAP<STRING,DOUBLE>)``; records without logs are ignored,
a record contributes to the training series when it has ``loss`` and to the evaluation
series when it has ``eval_loss``. Each series is numbered 1.. in ``seq`` order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_scan

# The log keys and the series they feed.
LOSS_KEYS = ("loss", "eval_loss")


def loss_records(logs: DataFrame, run_col: str = "run_id", seq_col: str = "seq", logs_col: str = "logs",
                 keys: Sequence[str] = LOSS_KEYS) -> DataFrame:
    """``(run_id, seq, kind, loss)`` for every key present; works on streams too (no order)."""
    m = F.col(logs_col)
    entries = F.array(*[
        F.when(F.map_contains_key(m, F.lit(k)), F.struct(F.lit(k).alias("kind"), m.getItem(k).alias("loss")))
        for k in keys
    ])
    present = F.filter(entries, lambda e: e.isNotNull())
    return logs.filter(m.isNotNull()).select(run_col, seq_col, F.explode(present).alias("_e")).select(
        run_col, seq_col, "_e.kind", "_e.loss"
    )


def loss_series(logs: DataFrame, run_col: str = "run_id", seq_col: str = "seq", logs_col: str = "logs",
                keys: Sequence[str] = LOSS_KEYS, num_partitions: int | None = None) -> DataFrame:
    """``(run_id, kind, step, seq, loss)``: position of each value within its series."""
    rec = loss_records(logs, run_col, seq_col, logs_col, keys)
    s = ordered_scan(rec, [run_col, "kind"], [seq_col], cum_col="_before", num_partitions=num_partitions)
    return s.select(run_col, "kind", (F.col("_before") + 1).cast("long").alias("step"), seq_col, "loss")
