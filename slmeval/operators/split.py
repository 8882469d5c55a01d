"""Exact, reproducible train/eval split; remainder; run numbering; fixed-size batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .ordered import ordered_scan


def split_key(id_col: str, seed: int = 42) -> Column:
    """Seeded order key: ``md5('<seed>:' || id)`` as lowercase hex (the same text in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def split_exact(
    df: DataFrame,
    id_col: str,
    frac: float = 0.8,
    seed: int = 42,
    prefix_bits: int = 20,
    flag_col: str = "in_train",
) -> DataFrame:
    """Flag exactly ``round(frac * n)`` rows (round half to even, as Python) as the train part.

    The rows with the smallest seeded keys ``(md5(seed:id), id)`` are taken. Ids must be unique and
    not NULL (checked by one grouped count of the ids; ``ValueError`` otherwise), else no key
    order would give an exact size. No global sort: one pass counts the rows per ``prefix_bits`` of
    the hash (a table of at most 2**prefix_bits rows, written once), the group holding the boundary
    follows from the running counts over it, and only that group is ordered, about
    n / 2**prefix_bits rows as md5 spreads unique ids evenly. The result is a filterable flag: one
    scan of ``df`` with a comparison of literals. Size and determinism equal
    ``df.sample(frac, random_state)``; membership differs.
    """
    hex_digits = max(1, (prefix_bits + 3) // 4)
    repeated = df.groupBy(F.col(id_col).alias("_i")).count().filter(F.col("_i").isNull() | (F.col("count") > 1)).take(1)
    if repeated:
        raise ValueError(f"split_exact needs unique ids that are not NULL; {repeated[0]['_i']!r} is on {repeated[0]['count']} rows")
    prefix = F.conv(F.substring("_h", 1, hex_digits), 16, 10).cast("long")
    ids = df.select(F.col(id_col).alias("_i"), split_key(id_col, seed).alias("_h")).withColumn("_p", prefix)
    counts = reliable_checkpoint(ids.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")))
    target = round(frac * (counts.agg(F.sum("_c")).first()[0] or 0))
    if target == 0:
        return df.withColumn(flag_col, F.lit(False))
    running = counts.withColumn(  # one row per hash prefix: bounded by 2**prefix_bits
        "_ci", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    )
    b = running.filter(F.col("_ci") >= target).agg(F.min_by(F.struct("_p", (F.col("_ci") - F.col("_c")).alias("below")), "_p")).first()[0]
    kth = ids.filter(F.col("_p") == b["_p"]).orderBy("_h", "_i").limit(target - b["below"]).agg(F.max(F.struct("_h", "_i"))).first()[0]
    h = split_key(id_col, seed)
    return df.withColumn(flag_col, (h < kth["_h"]) | ((h == kth["_h"]) & (F.col(id_col) <= F.lit(kth["_i"]))))


def train_eval(df: DataFrame, id_col: str, frac: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(train, eval)``: both read the same flags; eval is the exact complement."""
    flagged = split_exact(df, id_col, frac, seed, flag_col="_in_train")
    return (flagged.filter(F.col("_in_train")).drop("_in_train"), flagged.filter(~F.col("_in_train")).drop("_in_train"))


def remainder(df: DataFrame, subset: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``subset`` (drop by index; duplicates by content stay)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(subset.select(*keys), keys, "left_anti")


def number_runs(df: DataFrame, order_cols: Sequence[str | Column] | str, out_col: str = "run_no",
                num_partitions: int | None = None) -> DataFrame:
    """1-based position in ``order_cols`` order (``enumerate(..., 1)``), without one task for all rows."""
    s = ordered_scan(df, None, order_cols, cum_col="_before", num_partitions=num_partitions)
    return s.withColumn(out_col, (F.col("_before") + 1).cast("long")).drop("_before")


def make_batches(df: DataFrame, order_cols: Sequence[str | Column] | str, id_col: str, size: int = 3,
                 num_partitions: int | None = None) -> DataFrame:
    """Consecutive groups of ``size`` ids in order: ``(batch_id, ids)``; the last may be short."""
    orders = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    cols = [id_col] + [c for c in orders if isinstance(c, str) and c != id_col]
    numbered = number_runs(df.select(*cols), orders, "_rn", num_partitions)
    grouped = numbered.groupBy(F.floor((F.col("_rn") - 1) / F.lit(size)).cast("long").alias("batch_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rn").alias("rn"), F.col(id_col).alias("id")))).alias("_m")
    )
    return grouped.select("batch_id", F.transform("_m", lambda x: x["id"]).alias("ids"))
