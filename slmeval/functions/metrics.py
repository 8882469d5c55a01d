"""Metric expressions: elapsed time, memory units, CPU and RAM percentages, relative scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import col

MIB = 1024 * 1024


def elapsed_seconds(start, end, digits: int = 3) -> Column:
    """``round(end - start, 3)`` for start/end in seconds (``time.time()`` values).

    Rounded as Python rounds: half to even on the exact binary value.
    """
    from .format import round_to

    return round_to(col(end).cast("double") - col(start).cast("double"), digits)


def elapsed_between(start_ts, end_ts, digits: int = 3) -> Column:
    """Seconds between two TIMESTAMP / TIMESTAMP_NTZ columns rounded to ``digits`` decimals.

    Timestamps are whole microseconds, so the rounding is done exactly on integers (half away
    from zero) and only the final quotient is a double.
    """
    micros = F.timestamp_diff("MICROSECOND", col(start_ts), col(end_ts))  # exact, no time-zone cast
    unit = 10 ** (6 - digits)
    units = F.signum(micros).cast("long") * F.call_function("div", F.abs(micros) + F.lit(unit // 2), F.lit(unit))
    return units.cast("double") / F.lit(float(10**digits))


def bytes_to_mib(c) -> Column:
    """Bytes to MiB (``rss / (1024 * 1024)``)."""
    return col(c).cast("double") / F.lit(float(MIB))


def int_div(a, b) -> Column:
    """Integer division truncating toward zero (bash ``$(( a / b ))``); NULL when b is 0."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return F.when(b != 0, F.call_function("div", a, b))


def cpu_percent(delta_total, delta_idle) -> Column:
    """``100 * (dt - di) / dt`` in integer arithmetic; NULL when ``dt`` is NULL or not positive."""
    dt, di = col(delta_total).cast("long"), col(delta_idle).cast("long")
    return F.when(dt > 0, int_div(F.lit(100) * (dt - di), dt))


def memory_used(total_mb, available_mb) -> Column:
    """Used RAM in MB: total - available (``free -m`` fields 2 and 7)."""
    return col(total_mb).cast("long") - col(available_mb).cast("long")


def percent_of(part, total) -> Column:
    """``100 * part / total`` as a double; NULL when total is not positive."""
    t = col(total).cast("double")
    return F.when(t > 0, F.lit(100.0) * col(part).cast("double") / t)


def format_memory_used(total_mb, available_mb) -> Column:
    """``%dMB / %dMB (%.1f%%)`` of used, total and used percent."""
    from .format import fixed

    used = memory_used(total_mb, available_mb)
    return F.concat(used.cast("string"), F.lit("MB / "), col(total_mb).cast("long").cast("string"), F.lit("MB ("),
                    fixed(percent_of(used, total_mb), 1), F.lit("%)"))


def format_memory_available(total_mb, available_mb) -> Column:
    """``%dMB (%.1f%%)`` of available and available percent."""
    from .format import fixed

    return F.concat(col(available_mb).cast("long").cast("string"), F.lit("MB ("),
                    fixed(percent_of(available_mb, total_mb), 1), F.lit("%)"))


def relative_score(value, best) -> Column:
    """``best / value * 100`` when ``value > 0``, else 0.0 (a NULL value also gives 0.0)."""
    v = col(value)
    b = best if isinstance(best, Column) else F.lit(best)
    return F.when(v > 0, b / v * F.lit(100.0)).otherwise(F.lit(0.0))
