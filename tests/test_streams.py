import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from slmeval.operators import logs as lg
from slmeval.sources import runs as sr
from slmeval.streaming import cpu as scpu
from slmeval.streaming import latest as sl
from slmeval.streaming import runs as srun

T0 = dt.datetime(2024, 1, 1)


def _drain(q):
    q.awaitTermination()
    assert q.exception() is None


def test_latest_reading_table_is_kept_current(spark, tmp_path):
    schema = "device_id string, ts timestamp, cpu double"
    src, table, ck = str(tmp_path / "in"), str(tmp_path / "latest"), str(tmp_path / "ck")
    batches = [[("a", T0, 1.0), ("b", T0, 2.0)], [("a", T0 + dt.timedelta(seconds=5), 3.0)],
               [("b", T0 + dt.timedelta(seconds=1), 4.0), ("c", T0, 5.0)]]
    for b in batches:
        spark.createDataFrame(b, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        latest = sl.latest_reading_stream(stream, "device_id", "ts", ["cpu"])
        _drain(sl.write_latest(latest, table, ck, "device_id", "ts").trigger(availableNow=True).start())
    got = {r.device_id: r.cpu for r in sl.read_latest(spark, table).collect()}
    assert got == {"a": 3.0, "b": 4.0, "c": 5.0}


def test_a_crash_while_writing_loses_no_device(spark, tmp_path):
    schema = "device_id string, ts timestamp, cpu double"
    src, table, ck = str(tmp_path / "in"), str(tmp_path / "latest"), str(tmp_path / "ck")

    def step(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        latest = sl.latest_reading_stream(spark.readStream.schema(schema).parquet(src), "device_id", "ts", ["cpu"])
        _drain(sl.write_latest(latest, table, ck, "device_id", "ts").trigger(availableNow=True).start())
        return {r.device_id: r.cpu for r in sl.read_latest(spark, table).collect()}

    step([("a", T0, 1.0), ("b", T0, 2.0), (None, T0, 9.0)])
    (tmp_path / "latest" / "v7").mkdir()  # a version that was never committed
    later = T0 + dt.timedelta(seconds=5)
    assert step([("a", later, 3.0), (None, later, 8.0)]) == {"a": 3.0, "b": 2.0, None: 8.0}
    with pytest.raises(FileNotFoundError):
        sl.read_latest(spark, str(tmp_path / "nothing"))


def test_runs_to_csv_once_each(spark, tmp_path):
    schema = "answer string, ram_before double, ram_after double, cpu_usage double, inference_time double"
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    rows = [(f'say "{i}", then', 1.0 * i, 2.0, 3.0, 4.0) for i in range(12)]
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        _drain(srun.write_runs_stream(stream, out, ck).trigger(availableNow=True).start())
    assert sorted(tuple(r) for r in sr.read_runs(spark, out).collect()) == sorted(rows)  # every row once


def _step(rows, prev=None, tie=None):
    pdf = pd.DataFrame(rows, columns=["d", "ts", "tie", "snap_idle", "snap_total"])
    out, prev = scpu._advance(pdf, prev, "ts", tie, ["d", "ts", "tie"])
    take = lambda c: [None if pd.isna(x) else int(x) for x in out[c]]
    return list(zip(take("tie"), take("d_total"), take("d_idle"), take("cpu_pct"), take("late"))), prev


def test_stream_rules():
    t = [T0 + dt.timedelta(seconds=i) for i in range(6)]
    rows, prev = _step([("d", t[1], 1, 10, 100), ("d", t[2], 2, None, None), ("d", t[3], 3, 30, 300), ("d", None, 4, 1, 1)])
    assert rows == [(4, None, None, None, None), (1, None, None, None, 0), (2, None, None, None, 0), (3, None, None, None, 0)]
    rows, prev = _step([("d", t[4], 6, 40, 400), ("d", t[2], 5, 11, 111), ("d", t[3], 9, 35, 310)], prev)
    assert rows == [(5, None, None, None, 1), (9, 10, 5, 50, 0), (6, 90, 5, 94, 0)]
    rows, prev = _step([("d", t[5], 7, 1, 5), ("d", t[5], 8, 2, 9)], prev)  # a reboot, then a tie
    assert rows == [(7, None, None, None, 0), (8, 4, 1, 75, 0)]


def test_logs_on_streams(spark, tmp_path):
    logs = spark.createDataFrame([(1, 1, {"loss": 2.0}), (1, 2, None), (1, 3, {"eval_loss": 1.0, "loss": 0.5})],
                                 "run_id int, seq int, logs map<string,double>")
    logs.write.parquet(str(tmp_path / "logs"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "logs"))
    q = (srun.loss_records_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "rec"))
         .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    _drain(q)
    rec = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "rec")).collect())
    assert rec == [(1, 1, "loss", 2.0), (1, 3, "eval_loss", 1.0), (1, 3, "loss", 0.5)]
    series = sorted(tuple(r) for r in lg.loss_series(spark.read.parquet(str(tmp_path / "rec")).select(
        "run_id", "seq", F.create_map(F.col("kind"), F.col("loss")).alias("logs"))).collect())
    assert series == [(1, "eval_loss", 1, 3, 1.0), (1, "loss", 1, 1, 2.0), (1, "loss", 2, 3, 0.5)]


def test_rows_of_a_device_in_a_micro_batch_are_bounded(spark, tmp_path, monkeypatch):
    import json
    from collections import Counter

    from slmeval.plans import queries as q

    rows = [(i, 1 if i % 3 == 0 else i % 40, T0 + dt.timedelta(seconds=i // 2), "view" if i % 4 else "click", float(i % 7))
            for i in range(600)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(
        str(tmp_path / "sf" / "events.parquet"))
    monkeypatch.setattr(q, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(q, "DEVICE_ROWS", 60, raising=False)
    got = q.QUERIES["cpu_usage_stream"](spark, str(tmp_path / "sf"))
    batch = q.QUERIES["counter_delta"](spark, str(tmp_path / "sf")).select(*got.columns)
    text = lambda df: sorted(map(str, df.collect()))
    assert got.count() == 600 and text(got) == text(batch)
    logs = [p for p in (tmp_path / "cpu-stream" / "out" / "_spark_metadata").iterdir() if p.name.isdigit()]
    for log in logs:
        files = [json.loads(line)["path"] for line in log.read_text().splitlines()[1:]]
        held = Counter(r.device_id for f in files for r in spark.read.parquet(f).collect())
        assert max(held.values()) <= 60
    assert len(logs) >= 4


def test_devices_with_few_rows_are_cheap():
    import time

    rows = [("d", T0 + dt.timedelta(seconds=5 - i), i, 10 * i if i != 3 else None, 100 - i) for i in range(6)]
    pdf = pd.DataFrame(rows, columns=["d", "ts", "tie", "snap_idle", "snap_total"])
    took = []
    for _ in range(3):
        start = time.process_time()
        for _ in range(200):
            out, prev = scpu._advance(pdf, None, "ts", "tie", ["d", "ts", "tie"])
        took.append((time.process_time() - start) / 200)
    assert list(out["tie"]) == [5, 4, 3, 2, 1, 0] and prev[1:] == (0, 0, 100)
    assert min(took) < 0.002, took
