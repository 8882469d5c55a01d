"""Counter deltas of a stream whose devices may be hot: two levels, no group of a device's rows.

Inside a micro-batch the previous snapshots come from the ordered scan of the batch form, which spreads
a device over as many range partitions as its rows need; between micro-batches one row a device, its
last snapshot, is carried in a table of versions. So a device with any share of a micro-batch is the
work of many tasks, and state stays one row a device.

Rules: rows are taken in ``(ts, ties, counters)`` order after the carried snapshot of their device, so the
result does not depend on arrival inside a micro-batch. A row older than the carried snapshot has
``late`` true, a row without a time has ``late`` NULL; both have NULL deltas and change no state. NULL
counters give NULL deltas for their row and the next, a counter going backwards gives NULL. NULL
devices are one device, NULL ties come first. With rows in time order over the micro-batches the result
equals :func:`slmeval.operators.telemetry.counter_delta`.

The table folder holds ``out`` (the rows of each micro-batch), and ``state``; the version of the state is
written last and commits its micro-batch. The folder and the checkpoint belong together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import cpu_percent
from ..operators.ordered import _null_safe, ordered_scan
from ..operators.telemetry import snapshot_totals
from ..session import reliable_checkpoint
from . import versions as vs

_VALUES = ["_idle", "_total"]


def write_counter_deltas(snapshots: DataFrame, table_path: str, checkpoint: str, device_col: str = "device_id",
                         ts_col: str = "ts", counters_col: str = "counters", tie_cols: Sequence[str] = (),
                         keep_cols: Sequence[str] = (), num_partitions: int | None = None):
    """A writer of ``(device, ts, ties..., keep..., d_total, d_idle, cpu_pct, late)`` below ``table_path``;
    give it a trigger and start it, and read with :func:`read_counter_deltas`."""
    place = [ts_col, *tie_cols]
    out_cols = [device_col, *place, *keep_cols]
    idle, total = snapshot_totals(counters_col)

    def advance(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*out_cols, idle.alias("_idle"), total.alias("_total"), F.lit(1).alias("_new"))
        last = vs.before(spark, f"{table_path}/state", epoch_id)
        if last is None:
            rows = rows.withColumn("late", F.when(F.col(ts_col).isNotNull(), F.lit(False)))
        else:
            seen = last.select(device_col, F.struct(*place).alias("_seen"))
            rows = _null_safe(rows, seen, [device_col], "left").withColumn("late", F.when(
                F.col(ts_col).isNotNull(),
                F.coalesce(F.struct(*place) < F.col("_seen"), F.lit(False)))).drop("_seen")
        rows = reliable_checkpoint(rows)  # read by the scan, the state and the late rows
        used = rows.filter(~F.col("late"))
        if last is not None:  # the carried snapshots go before the rows of their device
            used = used.unionByName(last.withColumns({"_new": F.lit(0), "late": F.lit(False)}), allowMissingColumns=True)
        scan = ordered_scan(used, [device_col], [*place, "_new", "_total", "_idle"], carry=_VALUES, cum_col=None,
                            num_partitions=num_partitions).filter(F.col("_new") == 1)
        d_total, d_idle = F.col("_total") - F.col("prev__total"), F.col("_idle") - F.col("prev__idle")
        valid = (d_total >= 0) & (d_idle >= 0)
        deltas = scan.select(*out_cols, F.when(valid, d_total).alias("d_total"), F.when(valid, d_idle).alias("d_idle"),
                             F.when(valid, cpu_percent(d_total, d_idle)).alias("cpu_pct"), "late")
        aside = rows.filter(F.coalesce(F.col("late"), F.lit(True))).select(*out_cols, "late")
        vs.write_version(deltas.unionByName(aside, allowMissingColumns=True), f"{table_path}/out", epoch_id)
        kept = F.struct(*place, *_VALUES)
        newest = used.groupBy(device_col).agg(F.max_by(kept, F.struct(*place, "_new", "_total", "_idle")).alias("_m"))
        vs.write_version(newest.select(device_col, "_m.*"), f"{table_path}/state", epoch_id)
        vs.drop_older(spark, f"{table_path}/state", epoch_id)

    return snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(advance)


def read_counter_deltas(spark: SparkSession, table_path: str) -> DataFrame:
    """The rows of all micro-batches committed so far."""
    committed = vs.versions(spark, f"{table_path}/state")[-1:]
    done = [v for v in vs.versions(spark, f"{table_path}/out") if committed and v <= committed[0]]
    return vs.read_versions(spark, f"{table_path}/out", done)
