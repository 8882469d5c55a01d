import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from slmeval.operators.ordered import ordered_scan


def test_matches_window_with_hot_group(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        g = 0 if rnd.random() < 0.5 else rnd.randint(1, 40)  # group 0 holds half the rows
        rows.append((i, g, rnd.randint(0, 500), rnd.randint(-5, 20)))
    df = spark.createDataFrame(rows, "id long, g long, o long, w long")
    s = ordered_scan(df, ["g"], ["o", "id"], weight="w", carry=["w", "o"], total_col="tot", num_partitions=13)
    w = Window.partitionBy("g").orderBy("o", "id")
    ref = df.select(
        "id",
        F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cb"),
        F.lag("w").over(w).alias("pw"), F.lag("o").over(w).alias("po"),
        F.sum("w").over(Window.partitionBy("g")).alias("t"),
    )
    j = s.join(ref, "id")
    assert j.count() == 3000
    bad = j.filter((F.col("cum_before") != F.col("cb")) | ~F.col("prev_w").eqNullSafe(F.col("pw"))
                   | ~F.col("prev_o").eqNullSafe(F.col("po")) | (F.col("tot") != F.col("t")))
    assert bad.count() == 0


def test_global_numbering_and_empty_partitions(spark):
    df = spark.range(0, 50).withColumn("k", F.col("id") * 3)
    s = ordered_scan(df, None, ["k"], num_partitions=64)  # more partitions than rows
    assert sorted((r.id, r.cum_before) for r in s.collect()) == [(i, i) for i in range(50)]


def test_multiple_weights_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 2, 3), (None, 2, 5, 7), ("a", 1, 1, 1), ("a", 3, 1, 1)], "g string, o int, a long, b long")
    s = ordered_scan(df, ["g"], ["o"], weight={"ca": F.col("a"), "cb": F.col("b")}, num_partitions=3)
    got = sorted((r.g or "", r.o, r.ca, r.cb) for r in s.collect())
    assert got == [("", 1, 0, 0), ("", 2, 2, 3), ("a", 1, 0, 0), ("a", 3, 1, 1)]


def test_count_path_matches_row_number_with_hot_group(spark):
    rnd = random.Random(5)
    rows = [(i, 0 if rnd.random() < 0.6 else rnd.randint(1, 30), rnd.randint(0, 100)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g long, o long")
    s = ordered_scan(df, ["g"], ["o", "id"], total_col="n", num_partitions=11)
    w = Window.partitionBy("g").orderBy("o", "id")
    ref = df.select("id", (F.row_number().over(w) - 1).alias("rn"), F.count("*").over(Window.partitionBy("g")).alias("cnt"))
    j = s.join(ref, "id")
    assert j.count() == 4000
    assert j.filter((F.col("cum_before") != F.col("rn")) | (F.col("n") != F.col("cnt"))).count() == 0


def test_null_groups_on_the_count_path(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), (None, 2), (None, 3)], "g string, o int")
    for n in (1, 4):
        s = ordered_scan(df, ["g"], ["o"], total_col="n", num_partitions=n)
        assert sorted((r.g or "", r.o, r.cum_before, r.n) for r in s.collect()) == [
            ("", 1, 0, 3), ("", 2, 1, 3), ("", 3, 2, 3), ("a", 1, 0, 2), ("a", 2, 1, 2)]


def test_null_groups_keep_their_rows_in_cdf_and_series(spark):
    from slmeval.operators import logs, stats

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 1.0), (None, 1.0)], "k string, v double")
    assert sorted((r.k or "", r.cdf) for r in stats.empirical_cdf(df, "k", "v").collect()) == [("", 0.5), ("", 1.0), ("a", 0.5), ("a", 1.0)]
    assert sorted((r.k or "", r.cdf) for r in stats.empirical_cdf(df, "k", "v", points="distinct").collect()) == [
        ("", 1.0), ("a", 0.5), ("a", 1.0)]
    records = spark.createDataFrame([(None, 1, {"loss": 1.0}), (None, 2, {"loss": 2.0})], "run_id int, seq int, logs map<string,double>")
    assert sorted(r.step for r in logs.loss_series(records).collect()) == [1, 2]
