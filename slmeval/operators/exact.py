"""Means of doubles that do not depend on the order of addition.

A double is a whole number of 55 bits times a power of two. Sums are kept as whole numbers for each power of two, in three
parts of at most 19 bits, so a partial aggregate holds up to 2^44 rows without overflow and partial
aggregates merge exactly, in any order and under any partitioning. The parts of a group (one row for each
power of two that occurs, at most 2100) are added with whole numbers of any length; the sum is rounded to
a double once, and divided by the number of values.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 19
_TINY = 2.0**-900


def exponent_parts(x: Column) -> tuple[Column, list[Column]]:
    """(power, [low, middle, high]): x = (low + middle * 2^19 + high * 2^38) * 2^(power - 53), for finite x.
    The parts have the sign of x."""
    a = F.abs(x)
    small = a < F.lit(_TINY)  # scaled up first, as the factors below would overflow
    b = F.when(small, a * F.lit(2.0**200)).otherwise(a)
    power = F.when(b > 0, F.floor(F.log2(b))).otherwise(F.lit(0)).cast("int")  # one too high or too low at most
    # two factors, as one alone may overflow or vanish
    half = F.call_function("div", F.lit(53) - power, F.lit(2)).cast("int")
    m = b * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (F.lit(53) - power - half).cast("double"))
    m = F.when(x < 0, -m).otherwise(m).cast("long")
    size = F.abs(m)
    sign = F.when(m < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    mask = (1 << PART) - 1
    parts = [size.bitwiseAND(F.lit(mask)) * sign, F.shiftright(size, PART).bitwiseAND(F.lit(mask)) * sign, F.shiftright(size, 2 * PART) * sign]
    return (power - F.when(small, F.lit(200)).otherwise(F.lit(0))).cast("int"), parts


def _total(bins: list[dict] | None) -> float | None:
    """The double nearest to the sum of the bins."""
    if not bins:
        return 0.0
    least = min(b["power"] for b in bins)
    n = sum(((b["low"] or 0) + ((b["middle"] or 0) << PART) + ((b["high"] or 0) << 2 * PART)) << (b["power"] - least) for b in bins)
    shift = least - 53
    try:
        return float(Fraction(n) * Fraction(2) ** shift)
    except OverflowError:
        return float("inf") if n > 0 else float("-inf")


def _nearest(bins: str) -> Column:
    @F.arrow_udf("double")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_total(b) for b in batch.to_pylist()], type=pa.float64())

    return nearest(bins)


def exact_sums(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(groups, name, n, total): the number of values of each column of ``values`` that are not NULL and their sum, rounded
    once. A NaN, or infinities of both signs, make it NaN, as in floating-point addition. A group without values has n 0
    and total 0."""
    long = df.select(*groups, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values])).alias("v"))
    long = long.select(*groups, "v.name", "v.x")
    inf = float("inf")
    kind = (F.when(F.isnan("x"), 3).when(F.col("x") == F.lit(inf), 1).when(F.col("x") == F.lit(-inf), 2).otherwise(0))
    power, parts = exponent_parts(F.when(kind == 0, F.col("x")))
    binned = long.select(*groups, "name", kind.alias("kind"), power.alias("power"), F.col("x").isNotNull().alias("some"),
                         *[p.alias(n) for p, n in zip(parts, ("low", "middle", "high"))])
    bins = binned.groupBy(*groups, "name", "kind", "power").agg(
        F.count_if("some").alias("n"), *[F.sum(c).alias(c) for c in ("low", "middle", "high")])
    finite = (F.col("kind") == 0) & F.col("power").isNotNull()
    per = bins.groupBy(*groups, "name").agg(
        F.sum("n").alias("n"), F.collect_list(F.when(finite, F.struct("power", "low", "middle", "high"))).alias("bins"),
        F.max((F.col("kind") == 1).cast("int")).alias("up"), F.max((F.col("kind") == 2).cast("int")).alias("down"),
        F.max((F.col("kind") == 3).cast("int")).alias("nan"))
    total = (F.when((F.col("nan") == 1) | ((F.col("up") == 1) & (F.col("down") == 1)), F.lit(float("nan")))
             .when(F.col("up") == 1, F.lit(inf)).when(F.col("down") == 1, F.lit(-inf)).otherwise(F.col("nearest")))
    return per.withColumn("nearest", _nearest("bins")).select(*groups, "name", "n", total.alias("total"))


def exact_means(df: DataFrame, groups: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """(groups, one column for each of ``metrics``: out -> source): the exact sum rounded to a double, divided by the number of
    values; NULLs are skipped, a group without values has NULL."""
    sums = exact_sums(df, groups, list(dict.fromkeys(metrics.values())))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    out = [F.max(F.when(F.col("name") == src, mean)).alias(name) for name, src in metrics.items()]
    return sums.groupBy(*groups).agg(*out)
