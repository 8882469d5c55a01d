"""Ordered scans that stay balanced when one group holds a large share of the rows.

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task, so a group that
holds a third of the table is sorted and scanned by a single task. The scans here instead
range-partition the rows on ``(g, o)``: a hot group is spread over many partitions.

1. Range-partition and sort, then a reliable ``checkpoint()``: partition membership and order
   are then fixed even if a task is retried (and the lineage is cut), so the passes below see
   the same rows in the same places.
2. One aggregation per (partition, group) -- map-side, a partition holds a contiguous key
   range -- reduced to one row per partition: first and last group, the last group's sums and
   last row. Groups are contiguous in the range order, so only a partition's first group can
   continue from earlier partitions, and only from the last group of the nearest non-empty
   partition before it; a window over these P rows gives what each partition carries in
   (bounded by the partition count, broadcast).
3. Row numbers: position inside the partition minus the group's first position plus the
   carried count, all in the JVM. Weighted running sums and previous-row values: one ordered
   Arrow map per partition (pandas cumulative sums and shifts), seeded with the carried values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint

PID = "_slm_pid"
WEIGHT = "_slm_w"
_GROUP = "_slm_g"


def _names(cols: Sequence[str | Column] | str | Column | None) -> list:
    if cols is None:
        return []
    if isinstance(cols, (str, Column)):
        return [cols]
    return list(cols)


RANGE_ROWS = 500_000  # rows of a range that ``ranges_for`` aims at


def ranges_for(df: DataFrame) -> int | None:
    """Number of ranges for the rows of ``df`` (counted, so it should be cheap to read): a range keeps its size
    as the table grows. None, the adaptive planner's choice, for the rows of one range."""
    ranges = -(-df.count() // RANGE_ROWS)
    return max(ranges, df.sparkSession.sparkContext.defaultParallelism) if ranges > 1 else None


def range_checkpoint(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    num_partitions: int | None = None,
    materialise_input: bool = False,
) -> DataFrame:
    """Range-partition on (group, order), sort each partition, tag it with its id, checkpoint.

    Without ``num_partitions`` there are as many ranges as the session's shuffle partitions (or
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum``), of which the adaptive planner
    merges adjacent small ones; it never splits a range, so set that number (:func:`ranges_for`) for
    large tables.
    Range partitioning reads its input twice (sample, then shuffle): ``materialise_input`` writes
    an expensive input (Python, a model) once instead.
    """
    keys = [*group_cols, *order_cols]
    if materialise_input:
        df = reliable_checkpoint(df)
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys).withColumn(PID, F.spark_partition_id())
    return reliable_checkpoint(ranged)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal or both NULL ``keys``; the columns of ``left`` and the others of ``right``."""
    names = {k: f"_slm_r{i}" for i, k in enumerate(keys)}
    other = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in names])
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(other, on, how).drop(*names.values())


def _changes(pdf: pd.DataFrame, group_cols: list[str], prev_key: tuple | None) -> np.ndarray:
    """Boolean array: row i starts a new group (compared with row i-1, or prev_key for row 0)."""
    n = len(pdf)
    change = np.zeros(n, dtype=bool)
    for c in group_cols:
        s = pdf[c]
        sh = s.shift(1)
        diff = (s != sh) & ~(s.isna() & sh.isna())
        change |= diff.to_numpy(dtype=bool)
    if prev_key is None:
        change[0] = True
    else:
        change[0] = not _same_key(tuple(pdf[c].iat[0] for c in group_cols), prev_key)
    return change


def _same_key(a: tuple, b: tuple) -> bool:
    for x, y in zip(a, b):
        xn, yn = pd.isna(x), pd.isna(y)
        if xn or yn:
            if not (xn and yn):
                return False
        elif x != y:
            return False
    return True


def _scan(group_cols: list[str], carry: list[str], cum_cols: dict[str, str], prev_names: dict[str, str]):
    """Pass 2: exclusive running sums and previous row within each group, in partition order."""

    def run(batches):
        prev_key = None
        run_sum = {wc: 0 for wc in cum_cols}
        last_carry = None
        started = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            change = _changes(pdf, group_cols, prev_key)
            seg = np.cumsum(change)
            first_seg = seg == seg[0]
            drop = [*cum_cols, *[f"_off{wc}" for wc in cum_cols], "_has_prev", *[f"_pc_{c}" for c in carry], PID]
            out = pdf.drop(columns=drop)
            for wc, name in cum_cols.items():
                w = pdf[wc]
                excl = w.groupby(seg).cumsum() - w
                if not change[0]:
                    excl = excl.where(~first_seg, excl + run_sum[wc])
                elif not started:
                    off = pdf[f"_off{wc}"].iat[0]
                    excl = excl.where(~first_seg, excl + (0 if pd.isna(off) else off))
                run_sum[wc] = excl.iat[-1] + w.iat[-1]
                if name:
                    out[name] = excl.to_numpy()
            for c in carry:
                s = pdf[c]
                if pd.api.types.is_integer_dtype(s.dtype):
                    s = s.astype("Int64")  # exact integers with NULLs (no float64 detour)
                prev = s.shift(1)
                prev = prev.where(~change, None)
                if not change[0]:
                    prev.iat[0] = last_carry[carry.index(c)]
                elif not started and bool(pdf["_has_prev"].iat[0]):
                    prev.iat[0] = pdf[f"_pc_{c}"].iat[0]
                out[prev_names[c]] = prev  # same index as the batch
            last_carry = tuple(pdf[c].iat[-1] for c in carry)
            prev_key = tuple(pdf[c].iat[-1] for c in group_cols)
            started = True
            yield out

    return run


def _per_group(pos: DataFrame, groups: list[str], carry: list[str], wcols: list[str]) -> DataFrame:
    """Per (partition, group): first and last row position, weight sums, last carry values.
    Aggregated map-side: a partition holds a contiguous key range."""
    return pos.groupBy(PID, *groups).agg(
        F.min("_slm_pos").alias("_lo"),
        F.max("_slm_pos").alias("_hi"),
        *[F.sum(w).alias(f"_ls{w}") for w in wcols],
        *([F.max_by(F.struct(*[F.col(c).alias(f"c_{c}") for c in carry]), "_slm_pos").alias("_carry")] if carry else []),
    )


def _ends(per_group: DataFrame, groups: list[str], carry: list[str], wcols: list[str]) -> DataFrame:
    """One row per non-empty partition: first key, last key, last group's sums and carry."""
    last_fields = [F.col(g).alias(f"_l_{g}") for g in groups] + [F.col(f"_ls{w}") for w in wcols]
    if carry:
        last_fields.append(F.col("_carry"))
    ends = per_group.groupBy(PID).agg(
        F.min_by(F.struct(*[F.col(g).alias(f"_f_{g}") for g in groups]), "_lo").alias("_f"),
        F.max_by(F.struct(*last_fields), "_hi").alias("_l"),
    )
    return ends.select(
        PID,
        *[F.col(f"_f._f_{g}").alias(f"_f_{g}") for g in groups],
        *[F.col(f"_l._l_{g}").alias(f"_l_{g}") for g in groups],
        *[F.col(f"_l._ls{w}").alias(f"_ls{w}") for w in wcols],
        *[F.col(f"_l._carry.c_{c}").alias(f"_c_{c}") for c in carry],
    )


def _with_pos(ranged: DataFrame) -> DataFrame:
    """Row position: ``monotonically_increasing_id`` over the checkpointed partitions, whose
    membership and order are fixed, so every evaluation gives the same positions."""
    return ranged.withColumn("_slm_pos", F.monotonically_increasing_id())


def _offsets(summary: DataFrame, scan_groups: list[str], carry: list[str], wcols: list[str], by_name) -> DataFrame:
    """Per partition (P rows): what its first group carries in from earlier partitions."""
    by_pid = Window.orderBy(PID)  # one row per partition: bounded by the partition count
    last_keys = [f"_l_{c}" for c in scan_groups]
    by_last = Window.partitionBy(*last_keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, 0)
    s2 = summary
    for wc in wcols:
        s2 = s2.withColumn(f"_cl{wc}", F.sum(f"_ls{wc}").over(by_last))
    continues = F.lit(True)
    for c in scan_groups:
        continues = continues & F.lag(f"_l_{c}").over(by_pid).eqNullSafe(F.col(f"_f_{c}"))
    continues = continues & F.lag(PID).over(by_pid).isNotNull()
    return s2.select(
        PID,
        *[
            F.when(continues, F.lag(f"_cl{wc}").over(by_pid))
            .otherwise(F.lit(0))
            .cast(by_name[wc].dataType)
            .alias(f"_off{wc}")
            for wc in wcols
        ],
        F.coalesce(continues, F.lit(False)).alias("_has_prev"),
        *[F.when(continues, F.lag(f"_c_{c}").over(by_pid)).alias(f"_pc_{c}") for c in carry],
        *[F.col(f"_f_{g}") for g in scan_groups],
    )


def _count_scan(pos, per_group, offsets, scan_groups, wc, cum_col, total_col) -> DataFrame:
    """Row numbering without a Python pass: inside a partition the rows of a group are
    consecutive, so the count before a row is its position minus the group's first position
    there, plus what the partition's first group carries in. The per-(partition, group) table is
    joined back; the adaptive planner broadcasts it when its runtime size is small and
    shuffle-joins it otherwise (the partition id is part of the key, so a hot group stays split)."""
    is_first = F.lit(True)
    for g in scan_groups:
        is_first = is_first & F.col(g).eqNullSafe(F.col(f"_f_{g}"))
    base = per_group.join(F.broadcast(offsets), PID).select(
        PID, *scan_groups,
        (F.when(is_first, F.col(f"_off{wc}")).otherwise(F.lit(0)) - F.col("_lo")).alias("_base"),
    )
    out = _null_safe(pos, base, [PID, *scan_groups], "inner")
    cols = [c for c in pos.columns if c not in (PID, wc, "_slm_pos")]
    res = out.select(*cols, (F.col("_slm_pos") + F.col("_base")).alias(cum_col or "_slm_cum"))
    if total_col:
        totals = per_group.groupBy(*scan_groups).agg(F.sum(f"_ls{wc}").alias(total_col))
        res = _null_safe(res, totals, scan_groups, "left")
    return res if cum_col else res.drop("_slm_cum")


def ordered_scan(
    df: DataFrame,
    group_cols: Sequence[str] | str | None,
    order_cols: Sequence[str | Column] | str | Column,
    weight: str | Column | dict | None = None,
    carry: Sequence[str] | str | None = None,
    cum_col: str | None = "cum_before",
    prev_prefix: str = "prev_",
    total_col: str | None = None,
    num_partitions: int | None = None,
    materialise_input: bool = False,
) -> DataFrame:
    """Per group, in ``order_cols`` order: the sum of ``weight`` over the rows before each row
    (``cum_col``; weight 1 gives the 0-based row number) and the previous row's ``carry`` values
    (``prev_<c>``; NULL on a group's first row). ``total_col`` adds the group's total weight.
    ``weight`` may be a dict ``{out_col: expr}`` for several running sums in one scan.

    Order keys should be unique within a group for a deterministic result (add a tie-break
    column otherwise). Equivalent to ``sum(w) over (partition by g order by o rows between
    unbounded preceding and 1 preceding)`` and ``lag(c)``, without one task per group.
    """
    groups = [g if isinstance(g, str) else str(g) for g in _names(group_cols)]
    orders = _names(order_cols)
    carry = [c for c in _names(carry)]
    base = df
    if not groups:
        base = base.withColumn(_GROUP, F.lit(0))
        scan_groups = [_GROUP]
    else:
        scan_groups = groups
    if isinstance(weight, dict):
        wspec = dict(weight)
    else:
        wspec = {cum_col: F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)}
    cum_cols: dict[str, str] = {}
    for i, (out, expr) in enumerate(wspec.items()):
        wc = f"{WEIGHT}{i}"
        base = base.withColumn(wc, F.coalesce(expr, F.lit(0)))  # a NULL weight counts as 0
        if isinstance(base.schema[wc].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
            base = base.withColumn(wc, F.col(wc).cast("long"))
        cum_cols[wc] = out
    wcols = list(cum_cols)
    ranged = range_checkpoint(base, scan_groups, orders, num_partitions, materialise_input)
    by_name = {f.name: f for f in ranged.schema.fields}

    count_only = weight is None and not carry
    pos = _with_pos(ranged)
    per_group = _per_group(pos, scan_groups, carry, wcols)
    offsets = _offsets(_ends(per_group, scan_groups, carry, wcols), scan_groups, carry, wcols, by_name)
    if count_only:
        out = _count_scan(pos, per_group, offsets, scan_groups, wcols[0], cum_col, total_col)
        return out.drop(_GROUP) if not groups else out
    offsets = offsets.drop(*[f"_f_{g}" for g in scan_groups])

    prev_names = {c: f"{prev_prefix}{c}" for c in carry}
    out_fields = [f for f in ranged.schema.fields if f.name not in (*wcols, PID)]
    for wc, name in cum_cols.items():
        if name:
            out_fields.append(T.StructField(name, by_name[wc].dataType))
    for c in carry:
        out_fields.append(T.StructField(prev_names[c], by_name[c].dataType))
    # the broadcast join streams the checkpointed partitions: their order is kept, no second sort
    joined = ranged.join(F.broadcast(offsets), PID, "left")
    scanned = joined.mapInPandas(_scan(scan_groups, carry, cum_cols, prev_names), T.StructType(out_fields))
    if total_col:
        if len(wcols) != 1:
            raise ValueError("total_col needs a single weight")
        totals = ranged.groupBy(*scan_groups).agg(F.sum(wcols[0]).alias(total_col))
        scanned = _null_safe(scanned, totals, scan_groups, "left")
    if not groups:
        scanned = scanned.drop(_GROUP)
    return scanned
