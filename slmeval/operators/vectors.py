"""Vector columns: symmetric INT8 quantisation, argmax, mean of per-step samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import col
from ..functions.arrays import argmax_index, array_mean

INT8_MAX = 127


def int8_scale(v) -> Column:
    """``max(|x|) / 127`` over the vector (float32 values are widened to double first)."""
    return F.array_max(F.transform(col(v), lambda x: F.abs(x.cast("double")))) / F.lit(float(INT8_MAX))


def quantize_int8(df: DataFrame, vec_col: str, out_col: str = "q", scale_col: str = "scale") -> DataFrame:
    """Symmetric per-vector INT8: ``q = clamp(rint(x / scale), -127, 127)``, round half to even.

    A zero vector has scale 0 and all-zero codes (the division is guarded).
    """
    scale = F.col(scale_col)
    q = F.when(
        scale > 0,
        F.transform(
            col(vec_col),
            lambda x: F.greatest(F.lit(-INT8_MAX), F.least(F.lit(INT8_MAX), F.rint(x.cast("double") / scale).cast("int"))),
        ),
    ).otherwise(F.transform(col(vec_col), lambda x: F.lit(0)))
    return df.withColumn(scale_col, int8_scale(vec_col)).withColumn(out_col, q)


def dequantize_int8(q, scale) -> Column:
    """``q * scale`` back as doubles."""
    s = col(scale)
    return F.transform(col(q), lambda x: x.cast("double") * s)


def vector_stats(df: DataFrame, vec_col: str) -> DataFrame:
    """Adds ``argmax`` (0-based, first wins) and ``mean`` of each vector."""
    return df.withColumn("argmax", argmax_index(vec_col)).withColumn("mean", array_mean(vec_col))
