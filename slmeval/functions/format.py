"""Text reports: the per-run lines and the aligned scoreboard, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .._util import col


def pad_right(c, width: int) -> Column:
    """Python ``f"{x:<width}"``: pad with spaces to ``width``, never cut longer text."""
    c = col(c)
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


TWO53 = 2.0**53
_SPLIT = 2.0**27 + 1
_LIMB, _STEP = 10**9, 29


def _two_product(a: Column, b: float) -> tuple[Column, Column]:
    """(p, e) with p + e = a * b exactly and p the rounded product (halves of 26 bits, Dekker)."""
    t = a * F.lit(_SPLIT)
    high = t - (t - a)
    low = a - high
    b_high = _SPLIT * b - (_SPLIT * b - b)
    b_low = b - b_high
    p = a * F.lit(b)
    return p, ((high * F.lit(b_high) - p) + high * F.lit(b_low) + low * F.lit(b_high)) + low * F.lit(b_low)


def _integer_text(a: Column) -> Column:
    """All digits of a double of 2^53 or more: mantissa times a power of two in limbs of nine digits."""
    guess = F.floor(F.log2(a)).cast("int")  # may be one too high or too low
    shift = F.greatest(guess - 53, F.lit(0))
    mantissa = (a / F.pow(F.lit(2.0), shift.cast("double"))).cast("long")
    start = F.transform(F.array(F.lit(1), F.lit(_LIMB), F.lit(_LIMB**2)), lambda w: F.call_function("div", mantissa, w) % _LIMB)

    def times(limbs: Column, power: Column) -> Column:
        def add(now, limb):
            v = limb * power + now["carry"]
            return F.struct(F.call_function("div", v, F.lit(_LIMB)).alias("carry"), F.concat(now["out"], F.array(v % _LIMB)).alias("out"))

        zero = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(limbs, zero, add, lambda now: F.concat(now["out"], F.array(now["carry"])))

    full = F.call_function("div", shift, F.lit(_STEP)).cast("int")
    rest = F.pow(F.lit(2.0), (shift % _STEP).cast("double")).cast("long")
    limbs = F.aggregate(F.sequence(F.lit(0), full), start, lambda now, k: times(now, F.when(k == 0, rest).otherwise(F.lit(1 << _STEP))))
    digits = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.ltrim(digits, F.lit("0"))


def fixed(c, digits: int) -> Column:
    """``f"{x:.{digits}f}"``, digits 0 to 15: the exact binary value rounded half to even, as Python does it.

    Below 2^53 the fraction times 10^digits is taken as a rounded product and its exact error, so the
    comparison with one half is exact; from 2^53 on a double is a whole number, whose digits
    are worked out in whole-number limbs. Built-in expressions only. NaN and infinities print as in Python
    (``nan``, ``inf``, ``-inf``), and so does the sign of zero."""
    if not 0 <= digits <= 15:
        raise ValueError("digits must be 0 to 15")
    x = col(c).cast("double")
    a = F.abs(x)
    whole = F.floor(a)  # BIGINT
    p, e = _two_product(a - whole.cast("double"), float(10**digits))
    down = F.floor(p)
    above = (p - down.cast("double")) - F.lit(0.5)  # exact; the value lies above one half if this exceeds -e
    last = down if digits else whole
    up = (above > -e) | ((above == -e) & (last % 2 != 0))
    units = down + F.when(up, F.lit(1)).otherwise(F.lit(0))
    full = F.lit(10**digits)
    carry = F.when(units >= full, F.lit(1)).otherwise(F.lit(0))
    text = (whole + carry).cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((units - carry * full).cast("string"), digits, "0"))
    big = _integer_text(a)
    if digits:
        big = F.concat(big, F.lit("." + "0" * digits))
    negative = (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))
    inf = float("inf")
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == F.lit(inf), F.lit("inf"))
        .when(x == F.lit(-inf), F.lit("-inf"))
        .when(x.isNotNull(), F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), F.when(a < F.lit(TWO53), text).otherwise(big)))
    )


def round_to(c, digits: int) -> Column:
    """``round(x, digits)`` of a double as Python does it: the double nearest to :func:`fixed`."""
    return fixed(c, digits).cast("double")


def format_run_report(run_no, answer, latency, ram_before, ram_after, cpu_usage) -> Column:
    """The two report lines of one run::

        Run {n}: {answer}
           Time: {latency}s | RAM: {before:.2f}->{after:.2f} MB | CPU: {cpu:.2f}%
    """
    line1 = F.concat(F.lit("Run "), col(run_no).cast("string"), F.lit(": "), F.coalesce(col(answer), F.lit("None")))
    line2 = F.concat(
        F.lit("   Time: "), col(latency).cast("double").cast("string"), F.lit("s | RAM: "),
        fixed(ram_before, 2), F.lit("->"), fixed(ram_after, 2), F.lit(" MB | CPU: "), fixed(cpu_usage, 2), F.lit("%"),
    )
    return F.concat(line1, F.lit("\n"), line2)


def format_scoreboard_line(label, values: list, digits: list[int], width: int = 15) -> Column:
    """``f"{label:<15} {v1:<15.4f} {v2:<15.2f} ..."`` (fields joined by one space)."""
    parts = [pad_right(label, width)]
    for v, d in zip(values, digits):
        parts.append(pad_right(fixed(v, d), width))
    return F.concat_ws(" ", *parts)


# Title and column titles of the two printed tables.
SCOREBOARD = (
    ("===> Averages (lower is better)", ("Model", "Avg Time (s)", "Avg RAM (MB)", "Avg CPU (%)")),
    ("===> Scores (higher is better, min gets 100)", ("Model", "Time Score", "RAM Score", "CPU Score")),
)


def scoreboard_report(lines: DataFrame, table: int, label_col: str, line_col: str, width: int = 15) -> DataFrame:
    """``(line_no, line)`` of one printed table: title, padded column titles, then a line per label in
    label order. A scoreboard has one row per label, so numbering them is a small sort."""
    title, header = SCOREBOARD[table]
    top = lines.sparkSession.range(1).select(F.posexplode(F.array(
        F.lit(title), F.concat_ws(" ", *[pad_right(F.lit(h), width) for h in header]))).alias("line_no", "line"))
    number = F.row_number().over(Window.orderBy(label_col)) + 1
    return top.unionByName(lines.select(number.cast("int").alias("line_no"), F.col(line_col).alias("line")))
