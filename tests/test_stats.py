import math

import numpy as np
from pyspark.sql import functions as F

from slmeval.operators import stats


def _runs(spark, rows):
    return spark.createDataFrame(rows, "label string, inference_time double, ram_after double, cpu_usage double, ram_before double")


def test_cdf_rows_ties_single_null_nan(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", None), ("c", None),
            ("d", float("nan")), ("d", 4.0)]
    df = spark.createDataFrame(rows, "label string, v double")
    got = sorted((r.label, r.value, r["rank"], r.cdf) for r in stats.empirical_cdf(df, "label", "v", num_partitions=3).collect())
    assert got == [("a", 1.0, 1, 0.25), ("a", 2.0, 2, 0.5), ("a", 2.0, 3, 0.75), ("a", 3.0, 4, 1.0),
                   ("b", 5.0, 1, 1.0), ("d", 4.0, 1, 1.0)]
    dist = sorted((r.label, r.value, r.n_rows, r.cdf) for r in stats.empirical_cdf(df, "label", "v", "distinct").collect())
    assert ("a", 2.0, 2, 0.75) in dist and ("a", 1.0, 1, 0.25) in dist and len(dist) == 5


def test_cdf_matches_numpy_and_is_monotone(spark):
    rng = np.random.default_rng(0)
    vals = {"x": rng.integers(0, 20, 300).astype(float), "y": rng.normal(size=50)}
    rows = [(k, float(v)) for k, arr in vals.items() for v in arr]
    df = spark.createDataFrame(rows, "label string, v double")
    out = stats.empirical_cdf(df, "label", "v", num_partitions=7).collect()
    for k, arr in vals.items():
        mine = sorted((r.value, r.cdf) for r in out if r.label == k)
        ref = list(zip(np.sort(arr), np.arange(1, len(arr) + 1) / len(arr)))
        assert [v for v, _ in mine] == [float(v) for v, _ in ref]
        assert [c for _, c in mine] == [float(c) for _, c in ref]
        assert mine[-1][1] == 1.0


def test_means_skip_missing_and_summary_propagates_nan(spark):
    nan = float("nan")
    df = _runs(spark, [("A", 1.0, 10.0, nan, 1.0), ("A", 3.0, None, 5.0, 1.0), ("B", nan, 2.0, 1.0, 2.0)])
    m = {r.label: r for r in stats.mean_by_label(df).collect()}
    assert m["A"].avg_time == 2.0 and m["A"].avg_ram_after == 10.0 and m["A"].avg_cpu == 5.0
    assert m["B"].avg_time is None
    s = stats.run_summary(df).collect()[0]
    assert math.isnan(s.avg_time)
    s2 = stats.run_summary(df, skip_missing=True).collect()[0]
    assert s2.avg_time == 2.0


def test_scores_edge_cases(spark):
    avgs = spark.createDataFrame(
        [("best", 2.0, 4.0, -1.0), ("other", 4.0, 0.0, 2.0), ("empty", None, 8.0, 1.0), ("tie", 2.0, 4.0, 0.5)],
        "label string, avg_time double, avg_ram_after double, avg_cpu double")
    s = {r.label: r for r in stats.relative_scores(avgs).collect()}
    assert s["best"].score_time == 100.0 and s["tie"].score_time == 100.0  # tie for best
    assert s["other"].score_time == 50.0
    assert s["empty"].score_time == 0.0  # label without values
    assert s["other"].score_ram == 0.0  # zero mean
    assert s["best"].score_cpu == 0.0  # negative mean scores 0
    assert s["other"].score_cpu == -50.0  # a negative minimum gives negative scores
    single = spark.createDataFrame([("only", 3.0, 3.0, 3.0)], "label string, avg_time double, avg_ram_after double, avg_cpu double")
    assert stats.relative_scores(single).collect()[0].score_cpu == 100.0


def test_scores_plan_has_no_join(spark):
    avgs = spark.createDataFrame([("a", 1.0, 1.0, 1.0)], "label string, avg_time double, avg_ram_after double, avg_cpu double")
    plan = stats.relative_scores(avgs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_order_labels_and_radar(spark):
    df = spark.createDataFrame([("R", 1.0, 2.0, 3.0), ("A", 1.0, 2.0, 3.0), ("X", 1.0, 1.0, 1.0)],
                               "label string, score_time double, score_ram double, score_cpu double")
    assert [r.label for r in stats.order_labels(df, ["A", "N", "R"]).collect()] == ["X", "A", "R"]
    pts = stats.radar_points(df).filter("label = 'A'").orderBy("point").collect()
    ang = np.linspace(0, 2 * math.pi, 3, endpoint=False)
    assert [p.value for p in pts] == [1.0, 2.0, 3.0, 1.0]
    assert [p.angle for p in pts] == [float(a) for a in list(ang) + [ang[0]]]


def test_scores_come_from_unrounded_means(spark):
    df = spark.createDataFrame([("a", 2e-7), ("b", 3e-3)], "label string, t double")
    means = stats.mean_by_label(df, metrics={"avg_t": "t"})
    scores = {r.label: r.score_avg_t for r in stats.relative_scores(means, ["avg_t"]).collect()}
    assert scores["a"] == 100.0 and abs(scores["b"] - 0.0066666) < 1e-5


def test_cdf_ranges_follow_the_rows(spark, monkeypatch):
    from slmeval.operators import ordered

    monkeypatch.setattr(ordered, "RANGE_ROWS", 100, raising=False)
    written, checkpoint = [], ordered.range_checkpoint
    monkeypatch.setattr(ordered, "range_checkpoint", lambda *a, **k: written.append(checkpoint(*a, **k)) or written[-1])
    df = spark.range(2000).select(F.lit("A").alias("label"), (F.col("id") % 4).cast("double").alias("v"))
    got = stats.empirical_cdf(df, "label", "v").collect()
    assert sorted((r.value, r["rank"], r.cdf) for r in got) == [(float(i // 500), i + 1, (i + 1) / 2000) for i in range(2000)]
    assert max(r["count"] for r in written[-1].groupBy(ordered.PID).count().collect()) <= 300
