"""A hook on the records of a stream, called once per micro-batch and entered in a ledger.

The ledger is a folder of versions, one per micro-batch, with the records counted by kind. A micro-batch
that the ledger holds is not given to the hook again, whatever the stream replays after a restart; a
crash after the hook and before its entry gives the hook the same records under the same batch id, by
which it can make its own effect idempotent (write to a place named by the id, or upsert). The ledger
and the checkpoint belong together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import LOSS_KEYS, loss_records
from . import versions as vs


def write_log_hook(logs: DataFrame, hook: Callable[[DataFrame, int], None], ledger_path: str, checkpoint: str,
                   run_col: str = "run_id", seq_col: str = "seq", logs_col: str = "logs", keys: Sequence[str] = LOSS_KEYS):
    """A writer that calls ``hook(records, batch_id)`` with the loss records ``(run, seq, kind, loss)`` of each
    micro-batch; records without logs are left out, as in the batch form."""

    def call(batch: DataFrame, epoch_id: int) -> None:
        if epoch_id in vs.versions(batch.sparkSession, ledger_path):
            return
        records = loss_records(batch, run_col, seq_col, logs_col, keys)
        hook(records, epoch_id)
        counted = records.groupBy("kind").agg(F.count(F.lit(1)).alias("records"))
        vs.write_version(counted.select(F.lit(epoch_id).cast("long").alias("batch_id"), "kind", "records"),
                         ledger_path, epoch_id)

    return logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(call)


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """``(batch_id, kind, records)`` of the micro-batches entered so far."""
    return vs.read_versions(spark, ledger_path, vs.versions(spark, ledger_path))
