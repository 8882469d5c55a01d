"""CPU usage from a stream of counter snapshots; the previous snapshot of each device is state.

``lag`` is not available on streams, so each device keeps its last snapshot as streaming state
(``applyInPandasWithState`` by default, or a ``ValueState`` of ``transformWithStateInPandas``),
fault-tolerant through the checkpoint.
Rules: rows of a micro-batch are taken in ``(ts, tie)`` order, equal ones in arrival order, each
against the row before it, as in the batch form. Every row comes out: a row older than the stored
snapshot has ``late`` true and NULL deltas and leaves the state as it is; a row without a time has
``late`` NULL. NULL counters give NULL deltas for their row and the next. The first snapshot of a
device yields NULL deltas; a counter going backwards (reboot) yields NULL and the stored snapshot is
replaced. With the rows in time order the result equals the batch ``counter_delta``.

A device's rows of one micro-batch are held by one task; the source's trigger limits
(``maxFilesPerTrigger``, ``maxBytesPerTrigger``, ``maxOffsetsPerTrigger``) bound them. State is one row
per device.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.telemetry import snapshot_totals  # noqa: F401  (used on the driver only)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The processor is pickled by value: the Python runner that initialises it on the driver does not
# see files added with addPyFile, so it must not need to import this package.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])


def _whole(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(values, known) of a column of whole numbers; 0 where it has none."""
    given = column.to_numpy()
    known = pd.notna(given)
    values = np.zeros(len(given), dtype=np.int64)
    values[known] = given[known].astype(np.int64)
    return values, known


def _advance(pdf: pd.DataFrame, prev, ts_col: str, tie_col: str | None, out_cols: list[str]):
    """Apply the stream rules to one device's rows of a micro-batch, vectorised.

    ``prev`` is ``(ts_micros, tie, idle, total)`` of the stored snapshot or None; idle and total may be
    None. Returns the output rows (a pandas frame, as many as came in) and the new stored snapshot.
    A table has many devices with few rows each, so all is done in NumPy: a pandas operation on a
    few rows takes longer than the rows.
    """
    n = len(pdf)
    ts = pdf[ts_col] if pdf[ts_col].dtype.kind == "M" else pd.to_datetime(pdf[ts_col])
    ts_us = ts.to_numpy(dtype="datetime64[us]")
    timed, ts_us = ~np.isnat(ts_us), ts_us.astype(np.int64)  # NaT is the least number
    tie, tied = _whole(pdf[tie_col]) if tie_col else (np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool))
    order = np.lexsort((tie, tied, ts_us))  # stable; missing values first
    ts_us, timed, tie = ts_us[order], timed[order], tie[order]
    late = np.zeros(n, dtype=bool)
    if prev is not None:
        late = timed & ((ts_us < prev[0]) | ((ts_us == prev[0]) & (tie < prev[1])))
    used = np.flatnonzero(timed & ~late)
    at = order[used]
    known, delta, stored = np.ones(len(used), dtype=bool), {}, {}
    for name, last in (("snap_idle", 2), ("snap_total", 3)):
        values, given = _whole(pdf[name])
        values, given = values[at], given[at]
        first = prev is not None and prev[last] is not None
        before = np.append(np.int64(prev[last] if first else 0), values[:-1])
        known &= given & np.append(first, given[:-1])[: len(used)]
        delta[name] = values - before[: len(used)]
        stored[name] = int(values[-1]) if len(used) and given[-1] else None
    dt, di = delta["snap_total"], delta["snap_idle"]
    valid = known & (dt >= 0) & (di >= 0)  # a counter going backwards (reboot) gives NULL
    # dt >= 0 and di >= 0, but di may exceed dt: truncate toward zero, as bash
    busy, timely = 100 * (dt - di), valid & (dt > 0)
    share = np.abs(busy) // np.where(timely, dt, 1) * np.sign(busy)

    def spread(values, where):
        full, missing = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        full[used], missing[used] = values, ~where
        return pd.arrays.IntegerArray(full, missing)

    out = pd.DataFrame({**{c: pdf[c].array.take(order) for c in out_cols}, "d_total": spread(dt, valid), "d_idle": spread(di, valid),
                        "cpu_pct": spread(share, timely), "late": pd.arrays.BooleanArray(late, ~timed)})
    if len(used):
        prev = (int(ts_us[used[-1]]), int(tie[used[-1]]), stored["snap_idle"], stored["snap_total"])
    return out, prev


STATE_SCHEMA = T.StructType([
    T.StructField("ts_us", T.LongType()),
    T.StructField("tie", T.LongType()),
    T.StructField("idle", T.LongType()),
    T.StructField("total", T.LongType()),
])


def _together(pdfs) -> pd.DataFrame:
    parts = list(pdfs)
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def _group_state_update(ts_col: str, tie_col: str | None, out_cols: list[str]):
    def update(key, pdfs, state):
        pdf = _together(pdfs)
        out, prev = _advance(pdf, tuple(state.get) if state.exists else None, ts_col, tie_col, out_cols)
        if prev is not None:
            state.update(prev)
        yield out

    return update


class CounterDeltaProcessor(StatefulProcessor):
    def __init__(self, device_col: str, ts_col: str, tie_col: str | None, out_cols: Sequence[str]):
        self.device_col, self.ts_col, self.tie_col, self.out_cols = device_col, ts_col, tie_col, list(out_cols)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prev = handle.getValueState("prev", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _together(rows)
        stored = tuple(self.prev.get()) if self.prev.exists() else None
        out, prev = _advance(pdf, stored, self.ts_col, self.tie_col, self.out_cols)
        if prev is not None:
            self.prev.update(prev)
        if len(out):
            yield out

    def close(self) -> None:
        pass


def cpu_usage_stream(snapshots: DataFrame, device_col: str = "device_id", ts_col: str = "ts",
                     counters_col: str = "counters", tie_col: str | None = None,
                     keep_cols: Sequence[str] = (), api: str = "applyInPandasWithState") -> DataFrame:
    """Streaming ``(device, ts, [tie], keep..., d_total, d_idle, cpu_pct, late)``; output mode append.

    ``api='applyInPandasWithState'`` (default, ``GroupState``) or ``'transformWithState'``
    (``transformWithStateInPandas`` with a ``ValueState``; the session must use the RocksDB state
    store). Both apply the same rules.
    """
    spark = snapshots.sparkSession
    idle, total = snapshot_totals(counters_col)
    out_cols = [device_col, ts_col] + ([tie_col] if tie_col else []) + list(keep_cols)
    src = snapshots.select(*[F.col(c) for c in out_cols], idle.alias("snap_idle"), total.alias("snap_total"))
    by_name = {f.name: f for f in src.schema.fields}
    schema = T.StructType([by_name[c] for c in out_cols] + [
        T.StructField("d_total", T.LongType()), T.StructField("d_idle", T.LongType()), T.StructField("cpu_pct", T.LongType()),
        T.StructField("late", T.BooleanType()),
    ])
    grouped = src.groupBy(device_col)
    if api == "transformWithState":
        if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
            raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB} on the session")
        return grouped.transformWithStateInPandas(
            statefulProcessor=CounterDeltaProcessor(device_col, ts_col, tie_col, out_cols),
            outputStructType=schema, outputMode="Append", timeMode="None",
        )
    from pyspark.sql.streaming.state import GroupStateTimeout

    return grouped.applyInPandasWithState(
        _group_state_update(ts_col, tie_col, out_cols), schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
