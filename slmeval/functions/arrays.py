"""Array expressions for token sequences, score vectors and per-step samples (all native)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import col


def argmax_index(v) -> Column:
    """0-based index of the largest element; the first index wins ties (numpy ``argmax``).

    NULL for an empty or NULL array. NaN is not expected in logits.
    """
    v = col(v)
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)) - 1)


def truncate_at_eos(ids, eos_id: int | Column | None, max_new_tokens: int | Column) -> Column:
    """Keep the first ``max_new_tokens`` ids, cut after the first EOS (the EOS step is kept,
    as the reference appends the EOS token before it tests for it)."""
    ids = col(ids)
    limit = max_new_tokens if isinstance(max_new_tokens, Column) else F.lit(max_new_tokens)
    if eos_id is None:
        n = limit
    else:
        eos = eos_id if isinstance(eos_id, Column) else F.lit(eos_id)
        pos = F.array_position(ids, eos)
        n = F.when(pos > 0, F.least(limit, pos)).otherwise(limit)
    return _slice_n(ids, n)


def _slice_n(ids: Column, n: Column) -> Column:
    """``ids[:n]`` with n >= 0 (Spark's slice needs a positive length)."""
    return F.when(n <= 0, F.filter(ids, lambda x: F.lit(False))).otherwise(F.slice(ids, 1, n))


def new_tokens(ids, prompt_len) -> Column:
    """Suffix after the prompt: ``generated[prompt_len:]``."""
    ids = col(ids)
    n = prompt_len if isinstance(prompt_len, Column) else F.lit(prompt_len)
    rest = F.size(ids) - n
    return F.when(rest <= 0, F.filter(ids, lambda x: F.lit(False))).otherwise(F.slice(ids, n + 1, rest))


def strip_special_tokens(ids, special_ids) -> Column:
    """Drop special token ids (``decode(..., skip_special_tokens=True)``)."""
    special = F.array(*[F.lit(int(s)) for s in special_ids])
    return F.filter(col(ids), lambda x: ~F.array_contains(special, x))


def append_token(ids, token) -> Column:
    """``concat(ids, [token])``."""
    t = token if isinstance(token, Column) else F.lit(token)
    return F.concat(col(ids), F.array(t))


def array_mean(v) -> Column:
    """Mean of a numeric array, summed left to right; NULL when empty (``np.mean([])`` is NaN)."""
    v = col(v)
    total = F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(v) > 0, total / F.size(v))


def array_sum_long(v) -> Column:
    """Sum of an integer array as BIGINT."""
    return F.aggregate(col(v), F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def close_loop(v) -> Column:
    """Repeat the first element at the end (closes a radar polygon)."""
    v = col(v)
    return F.concat(v, F.slice(v, 1, 1))


def radar_angles(n: int) -> Column:
    """``linspace(0, 2*pi, n, endpoint=False)``: i * (2*pi / n) for i in 0..n-1."""
    step = F.lit(2.0) * F.pi() / F.lit(float(n))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double") * step)
