"""Loss series numbered as they arrive: step numbers on a stream, late records put in order.

A series is a ``(run, kind)``. Each micro-batch numbers the records that no other is expected before
(``seq`` up to the largest one seen of the series less ``delay``), after the steps counted so far, by the
ordered scan of the batch form: a run with any share of the records is the work of many tasks. Later
records are held for the micro-batches after it. State is one row a series (steps, last number, largest
``seq``) and the held records.

Rules: a record older than the last one numbered of its series has ``late`` true and no step; a record
without a ``seq`` has ``late`` NULL and no step; both come out at once. NULL runs are one run. Records of
equal ``seq`` are taken in ``loss`` order inside a micro-batch. Where no record comes more than ``delay``
behind the largest of its series, the result, held records included, equals
:func:`slmeval.operators.logs.loss_series`.

The table folder holds ``out``, ``held`` and ``state``; the version of the state is written last and commits
its micro-batch. The folder and the checkpoint belong together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import LOSS_KEYS, loss_records
from ..operators.ordered import _null_safe, ordered_scan
from ..session import reliable_checkpoint
from . import versions as vs


def _numbered(ready: DataFrame, run_col: str, seq_col: str, num_partitions: int | None = None) -> DataFrame:
    """Steps of the records ``ready``, counted on from the column ``_steps`` of their series."""
    s = ordered_scan(ready, [run_col, "kind"], [seq_col, "loss"], cum_col="_before", num_partitions=num_partitions)
    return s.select(run_col, "kind", (F.col("_steps") + F.col("_before") + 1).cast("long").alias("step"), seq_col, "loss",
                    F.lit(False).alias("late"))


def write_loss_series(logs: DataFrame, table_path: str, checkpoint: str, delay: int = 0, run_col: str = "run_id",
                      seq_col: str = "seq", logs_col: str = "logs", keys: Sequence[str] = LOSS_KEYS,
                      num_partitions: int | None = None):
    """A writer of ``(run, kind, step, seq, loss, late)`` below ``table_path``; give it a trigger and start
    it, and read with :func:`read_loss_series`."""
    series = [run_col, "kind"]
    columns = [run_col, "kind", seq_col, "loss"]

    def advance(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        rows = loss_records(batch, run_col, seq_col, logs_col, keys).select(*columns)
        held, state = vs.before(spark, f"{table_path}/held", epoch_id), vs.before(spark, f"{table_path}/state", epoch_id)
        if held is not None:
            rows = rows.unionByName(held)
        seen = rows.groupBy(*series).agg(F.lit(0).cast("long").alias("_steps"),
                                         F.max(F.lit(None).cast(rows.schema[seq_col].dataType)).alias("_last"),
                                         F.max(seq_col).alias("_seen"))
        if state is not None:
            seen = seen.unionByName(state).groupBy(*series).agg(
                *[F.max(c).alias(c) for c in ("_steps", "_last", "_seen")])
        seen = reliable_checkpoint(seen)
        rows = reliable_checkpoint(_null_safe(rows, seen, series, "left").withColumn(
            "late", F.when(F.col(seq_col).isNotNull(), F.coalesce(F.col(seq_col) < F.col("_last"), F.lit(False)))))
        due = F.col(seq_col) <= F.col("_seen") - F.lit(delay)
        ready = rows.filter(~F.col("late") & due)
        aside = rows.filter(F.coalesce(F.col("late"), F.lit(True))).select(*columns, "late")
        out = _numbered(ready, run_col, seq_col, num_partitions).unionByName(aside, allowMissingColumns=True)
        vs.write_version(out, f"{table_path}/out", epoch_id)
        vs.write_version(rows.filter(~F.col("late") & ~due).select(*columns), f"{table_path}/held", epoch_id)
        counted = ready.groupBy(*series).agg(F.count(F.lit(1)).alias("_steps"), F.max(seq_col).alias("_last"))
        after = seen.unionByName(counted, allowMissingColumns=True).groupBy(*series).agg(
            F.sum("_steps").alias("_steps"), F.max("_last").alias("_last"), F.max("_seen").alias("_seen"))
        vs.write_version(after, f"{table_path}/state", epoch_id)
        for part in ("held", "state"):
            vs.drop_older(spark, f"{table_path}/{part}", epoch_id)

    return logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(advance)


def read_loss_series(spark: SparkSession, table_path: str, held: bool = True, run_col: str = "run_id",
                     seq_col: str = "seq") -> DataFrame:
    """The records of all micro-batches committed so far; ``held`` numbers those still held, in the order
    known by now, after them."""
    committed = vs.versions(spark, f"{table_path}/state")[-1:]
    done = [v for v in vs.versions(spark, f"{table_path}/out") if committed and v <= committed[0]]
    out = vs.read_versions(spark, f"{table_path}/out", done)
    if not held:
        return out
    state = vs.read_versions(spark, f"{table_path}/state", committed).select(run_col, "kind", "_steps")
    waiting = vs.read_versions(spark, f"{table_path}/held", committed)
    rest = _null_safe(waiting, state, [run_col, "kind"], "left")
    return out.unionByName(_numbered(rest, run_col, seq_col))
