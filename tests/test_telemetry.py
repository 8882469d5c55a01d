import datetime as dt

import pytest

from slmeval.functions.metrics import cpu_percent, elapsed_between, format_memory_available, format_memory_used
from slmeval.operators import telemetry as tm

T0 = dt.datetime(2024, 1, 1)


def _snap(dev, sec, busy, idle, eid):
    return (dev, T0 + dt.timedelta(seconds=sec), [busy, 0, 0, idle, 0, 0, 0, 0, 0, 0], eid)


ROWS = [
    _snap("a", 0, 100, 100, 1),  # first row of a device
    _snap("b", 0, 50, 50, 2),
    _snap("a", 1, 150, 150, 3),  # interleaved devices
    _snap("b", 1, 50, 50, 4),  # equal snapshots: zero delta
    _snap("a", 2, 160, 190, 5),
    _snap("a", 3, 10, 10, 6),  # counter reset
    _snap("a", 4, 40, 20, 7),
]


def _bash_cpu(pt, pi, ct, ci):
    dt_, di = ct - pt, ci - pi
    return int(100 * (dt_ - di) / dt_)  # bash integer division truncates toward zero


def test_counter_delta_cases(spark):
    df = spark.createDataFrame(ROWS, "device_id string, ts timestamp, counters array<bigint>, eid long")
    out = {r.eid: r for r in tm.counter_delta(df, tie_cols=["eid"], num_partitions=3).collect()}
    assert out[1].cpu_pct is None and out[2].cpu_pct is None
    assert out[3].d_total == 100 and out[3].d_idle == 50 and out[3].cpu_pct == _bash_cpu(200, 100, 300, 150)
    assert out[4].d_total == 0 and out[4].cpu_pct is None
    assert out[5].cpu_pct == _bash_cpu(300, 150, 350, 190)
    assert out[6].d_total is None and out[6].cpu_pct is None  # reset
    assert out[7].cpu_pct == _bash_cpu(20, 10, 60, 20)


def test_cpu_percent_truncates_toward_zero(spark):
    r = spark.createDataFrame([(3, 1), (7, 9)], "t long, i long").select(cpu_percent("t", "i").alias("c")).collect()
    assert [x.c for x in r] == [66, -28]


def test_memory_formats_like_awk(spark):
    df = spark.createDataFrame([(8191, 4000), (7919, 1)], "total_mb long, available_mb long")
    out = df.select(format_memory_used("total_mb", "available_mb").alias("u"),
                    format_memory_available("total_mb", "available_mb").alias("a")).collect()
    for (t, a), r in zip([(8191, 4000), (7919, 1)], out):
        used = t - a
        assert r.u == "%dMB / %dMB (%.1f%%)" % (used, t, 100 * used / t)
        assert r.a == "%dMB (%.1f%%)" % (a, 100 * a / t)


def test_elapsed_between_rounds_exactly(spark):
    df = spark.createDataFrame([(T0, T0 + dt.timedelta(microseconds=1234500)), (T0 + dt.timedelta(seconds=2), T0)],
                               "s timestamp, e timestamp")
    assert [r[0] for r in df.select(elapsed_between("s", "e")).collect()] == [1.235, -2.0]


def test_latest_reading(spark):
    df = spark.createDataFrame(ROWS, "device_id string, ts timestamp, counters array<bigint>, eid long")
    got = {r.device_id: r.eid for r in tm.latest_reading(df, "device_id", "ts", ["eid"]).collect()}
    assert got == {"a": 7, "b": 4}


@pytest.mark.parametrize("api", ["applyInPandasWithState", "transformWithState"])
def test_stream_equals_batch_and_flags_late_rows(spark, tmp_path, api):
    from slmeval.streaming.cpu import cpu_usage_stream

    schema = "device_id string, ts timestamp, counters array<bigint>, eid long"
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    batches = [ROWS[:3], ROWS[3:5], ROWS[5:], [_snap("a", 1, 999, 999, 99)]]  # last batch: a late row
    for b in batches:
        spark.createDataFrame(b, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = (cpu_usage_stream(stream, tie_col="eid", api=api).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [(r.eid, r.d_total, r.d_idle, r.cpu_pct) for r in rows if r.late] == [(99, None, None, None)]
    got = {r.eid: (r.d_total, r.d_idle, r.cpu_pct) for r in rows if not r.late}
    ref = {r.eid: (r.d_total, r.d_idle, r.cpu_pct)
           for r in tm.counter_delta(spark.createDataFrame(ROWS, schema), tie_cols=["eid"]).collect()}
    assert got == ref


def test_counter_delta_within_one_reading(spark):
    # two snapshots per reading (the reference samples, sleeps 1 s, samples again); readings are
    # not compared with each other when pair_col is given
    rows = [("a", 0, 100, 50, 1, 1), ("a", 1, 200, 80, 1, 2), ("a", 3, 300, 90, 2, 3), ("a", 4, 360, 120, 2, 4)]
    df = spark.createDataFrame(
        [(d, T0 + dt.timedelta(seconds=s), [b, 0, 0, i], r, e) for d, s, b, i, r, e in rows],
        "device_id string, ts timestamp, counters array<bigint>, reading long, eid long")
    out = {r.eid: r.cpu_pct for r in tm.counter_delta(df, pair_col="reading", tie_cols=["eid"]).collect()}
    assert out == {1: None, 2: _bash_cpu(150, 50, 280, 80), 3: None, 4: _bash_cpu(390, 90, 480, 120)}
