import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from slmeval.functions import format as fmt
from slmeval.functions import metrics as mt

TIES = [2.675, 0.125, 0.375, 0.5, 1.5, 2.5, -0.5, -2.5, 0.045, 1.005, 1e22, 1e23, 2.0**53, 2.0**53 - 1, 2.0**63, 2.0**64 + 2.0**12, 1.7976931348623157e308,
        5e-324, -5e-324, 0.0, -0.0, -0.001, 0.995, 9.995, 99.5, 999999.9999999999, 0.9999999999999999, 4503599627370495.5, 4503599627370496.5,
        1234567.8949999999, 123456789012345.67, math.pi * 1e15, 1e21, 123e120, float("nan"), float("inf"), float("-inf")]


def doubles(seed, n):
    rnd = random.Random(seed)
    out = [struct.unpack("<d", rnd.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(n)]
    out += [rnd.randint(-10**6, 10**6) / rnd.choice([8, 16, 64, 1000, 200, 1024]) for _ in range(n)]
    out += [rnd.uniform(0, 1) * 10 ** rnd.randint(-12, 18) for _ in range(n)]
    return [x for x in out if not math.isnan(x)]


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4, 9, 15])
def test_decimal_text_equals_python(spark, digits):
    values = TIES + doubles(digits, 1500)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)] + [(-1, None)], "i int, x double")
    got = {r.i: r.t for r in df.select("i", fmt.fixed("x", digits).alias("t")).collect()}
    assert got.pop(-1) is None
    wrong = [(x, got[i], f"{x:.{digits}f}") for i, x in enumerate(values) if got[i] != f"{x:.{digits}f}"]
    assert not wrong, wrong[:5]


def test_rounded_seconds_equal_python(spark):
    values = [x for x in TIES + doubles(77, 1500) if math.isfinite(x)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = {r.i: r.t for r in df.select("i", mt.elapsed_seconds(F.lit(0.0), "x").alias("t")).collect()}
    assert all(got[i] == round(x - 0.0, 3) for i, x in enumerate(values))


def test_digits_are_bounded(spark):
    with pytest.raises(ValueError):
        fmt.fixed("x", 16)


def plain_total(values):
    some = [x for x in values if x is not None]
    if any(math.isnan(x) for x in some) or (math.inf in some and -math.inf in some):
        return len(some), math.nan
    if any(math.isinf(x) for x in some):
        return len(some), next(x for x in some if math.isinf(x))
    total = sum((Fraction(x) for x in some), Fraction(0))
    try:
        return len(some), float(total)
    except OverflowError:
        return len(some), math.inf if total > 0 else -math.inf


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_exact_sums_under_any_partitioning(spark, parts):
    from slmeval.operators.exact import exact_sums

    groups = {"wild": [x for x in doubles(1, 800) if math.isfinite(x)], "cancel": [1e308, 1.0, -1e308, 1e-300, -1.0, 1e16, 1.0, -1e16],
              "tiny": [5e-324, 5e-324, -2.5e-308, 2.0**-1060, 1.5e-310], "none": [None, None], "nan": [1.0, float("nan")],
              "inf": [float("inf"), 1.0], "both": [float("inf"), float("-inf")], "over": [1.7e308, 1.7e308], "powers": [2.0**k for k in range(-1074, 1024)],
              "below": [math.nextafter(2.0**k, 0) for k in range(-1070, 1024, 7)], None: [0.1] * 10, "zero": [0.0, -0.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
    got = {r.g: (r.n, r.total) for r in exact_sums(df, ["g"], ["x"]).collect()}
    for g, xs in groups.items():
        n, total = plain_total(xs)
        assert got[g][0] == n and (got[g][1] == total or (math.isnan(total) and math.isnan(got[g][1]))), g
    assert exact_sums(df.limit(0), [], ["x"]).count() == 0


def test_means_do_not_depend_on_partitioning(spark):
    from slmeval.operators import stats

    rnd = random.Random(5)
    rows = [(rnd.choice("AB"), rnd.uniform(0, 1e9) * 10 ** rnd.randint(-9, 3)) for _ in range(5000)] + [("A", None), ("B", float("nan"))]
    df = spark.createDataFrame(rows, "label string, x double")
    seen = {tuple(sorted(map(tuple, stats.mean_by_label(df.repartition(p), metrics={"m": "x"}).collect()))) for p in (1, 2, 7, 16)}
    assert len(seen) == 1
    got = dict(seen.pop())
    for g in "AB":
        xs = [x for k, x in rows if k == g and x is not None and not math.isnan(x)]
        assert got[g] == float(sum(map(Fraction, xs))) / len(xs)


def test_sketch_curve_is_within_its_error(spark):
    from slmeval.operators import stats

    rnd = random.Random(6)
    data = {"normal": sorted(rnd.gauss(0, 1) for _ in range(30000)), "ties": sorted(float(rnd.randint(0, 9)) for _ in range(20000)), "one": [4.0], None: [1.0, 2.0]}
    rows = [(g, x) for g, xs in data.items() for x in xs] + [("normal", None), ("ties", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(9)
    got = stats.sketch_cdf(df, "g", "x", points=50, k=400).collect()
    assert {r.g for r in got} == set(data) and len(got) == 200
    import bisect
    for r in got:
        xs, slack = data[r.g], 2 * stats.sketch_rank_error(400)
        assert r.cdf == r.point / 50 and r.value in xs
        assert bisect.bisect_left(xs, r.value) / len(xs) - slack <= r.cdf <= bisect.bisect_right(xs, r.value) / len(xs) + slack
    plan = stats.sketch_cdf(df, "g", "x")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan
