"""Skew: a key holding most of the rows must not end up in one task."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from slmeval.operators.ordered import PID, range_checkpoint

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_hot_group_spreads_over_range_partitions(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 5 < 3, F.lit(0)).otherwise(F.col("id") % 97).alias("g"),  # group 0: 60 %
        F.col("id").alias("o"))
    r = range_checkpoint(df, ["g"], ["o"], num_partitions=10)
    sizes = [row["count"] for row in r.groupBy(PID).count().collect()]
    hot_parts = r.filter("g = 0").select(PID).distinct().count()
    assert max(sizes) <= 0.2 * 20000  # no partition holds the hot group
    assert hot_parts >= 5


def test_python_input_runs_once(spark):
    from slmeval.operators.ordered import ordered_scan

    seen = spark.sparkContext.accumulator(0)

    def tag(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf.assign(w=pdf["id"] % 3)

    src = spark.range(0, 3000, 1, 4).mapInPandas(tag, "id long, w long")
    out = ordered_scan(src, None, ["id"], weight="w", num_partitions=5, materialise_input=True).collect()
    assert len(out) == 3000
    assert seen.value == 3000  # sampled and shuffled from one materialisation, not run twice
