"""Property tests: the skew-safe scans equal window functions on random tables."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from slmeval.operators.ordered import ordered_scan

rows_strategy = st.lists(
    st.tuples(st.integers(0, 3), st.integers(-5, 5), st.integers(-3, 9)), min_size=0, max_size=60
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, parts=st.integers(1, 9))
def test_scan_equals_window(spark, rows, parts):
    data = [(i, g, o, w) for i, (g, o, w) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g long, o long, w long")
    w = Window.partitionBy("g").orderBy("o", "id")
    ref = {r.id: (r.rn, r.cb, r.pw) for r in df.select(
        "id", (F.row_number().over(w) - 1).alias("rn"),
        F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cb"),
        F.lag("w").over(w).alias("pw")).collect()}
    counted = {r.id: r.cum_before for r in ordered_scan(df, ["g"], ["o", "id"], num_partitions=parts).collect()}
    weighted = {r.id: (r.cum_before, r.prev_w) for r in
                ordered_scan(df, ["g"], ["o", "id"], weight="w", carry=["w"], num_partitions=parts).collect()}
    assert counted == {k: v[0] for k, v in ref.items()}
    assert weighted == {k: (v[1], v[2]) for k, v in ref.items()}
