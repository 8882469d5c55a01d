import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from slmeval.operators import logs as lg
from slmeval.operators import telemetry as tl
from slmeval.sources import frames as sfr
from slmeval.streaming import deltas as sde
from slmeval.streaming import hooks as sho
from slmeval.streaming import series as sse

T0 = dt.datetime(2024, 1, 1)
SNAPS = "device_id string, ts timestamp, tie int, counters array<bigint>, note string"


def _feed(spark, rows, schema, src, step):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    q = step(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(src)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def _snap(device, second, tie, idle, busy, note=None):
    ts = None if second is None else T0 + dt.timedelta(seconds=second)
    return (device, ts, tie, None if idle is None else [busy, 0, 0, idle], note)


def _deltas(tmp_path):
    step = lambda s: sde.write_counter_deltas(s, str(tmp_path / "table"), str(tmp_path / "ck"),
                                              tie_cols=["tie"], keep_cols=["note"])
    return str(tmp_path / "in"), step


def test_deltas_over_restarts_equal_the_batch_form(spark, tmp_path):
    src, step = _deltas(tmp_path)
    rows = [_snap("hot" if i % 3 else f"d{i % 5}", i // 2, i, 3 * i if i != 40 else 0, 5 * i if i != 40 else 0) for i in range(90)]
    rows += [_snap(None, i, i, i, 2 * i) for i in range(0, 45, 4)]
    for lo, hi in ((0, 10), (10, 11), (11, 30), (30, 99)):
        part = [r for r in rows if lo <= (r[1] - T0).seconds < hi]
        _feed(spark, part, SNAPS, src, step)
    got = sde.read_counter_deltas(spark, str(tmp_path / "table"))
    want = tl.counter_delta(spark.createDataFrame(rows, SNAPS), tie_cols=["tie"])
    cols = ["device_id", "ts", "tie", "d_total", "d_idle", "cpu_pct"]
    text = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert got.filter("late").count() == 0 and text(got) == text(want)


def test_late_untimed_and_broken_snapshots(spark, tmp_path):
    src, step = _deltas(tmp_path)
    _feed(spark, [_snap("a", 5, 1, 10, 10, "first"), _snap("a", None, 1, 99, 99, "untimed")], SNAPS, src, step)
    _feed(spark, [_snap("a", 4, 1, 11, 11, "late"), _snap("a", 5, 0, 11, 11, "late tie"), _snap("a", 5, 1, 12, 13, "same place"),
                  _snap("a", 6, 1, None, None, "broken"), _snap("a", 7, 1, 20, 20, "after broken")], SNAPS, src, step)
    _feed(spark, [], SNAPS, src, step)  # nothing new
    _feed(spark, [_snap("a", 8, 1, 5, 5, "reboot"), _snap("a", 9, 1, 6, 8, "next"), _snap("b", 1, 1, 1, 1, "new")], SNAPS, src, step)
    got = {r.note: (r.d_total, r.d_idle, r.cpu_pct, r.late) for r in sde.read_counter_deltas(spark, str(tmp_path / "table")).collect()}
    assert got == {"first": (None, None, None, False), "untimed": (None, None, None, None), "late": (None, None, None, True),
                   "late tie": (None, None, None, True), "same place": (5, 2, 60, False), "broken": (None, None, None, False),
                   "after broken": (None, None, None, False), "reboot": (None, None, None, False), "next": (4, 1, 75, False),
                   "new": (None, None, None, False)}


def test_a_replayed_micro_batch_gives_its_rows_once(spark, tmp_path):
    src, step = _deltas(tmp_path)
    for k in range(3):
        _feed(spark, [_snap("a", 2 * k, 1, k, k, f"{k}"), _snap("a", 2 * k + 1, 1, k + 1, k + 2, f"{k}+")], SNAPS, src, step)
    table = lambda: sorted(map(str, sde.read_counter_deltas(spark, str(tmp_path / "table")).collect()))
    whole = table()
    # a crash before the last batch was committed: its commit and its state are missing, its rows half written
    (tmp_path / "ck" / "commits" / "2").unlink()
    (tmp_path / "ck" / "commits" / ".2.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "table" / "state" / "v2")
    assert len(table()) == 4  # the batch is not read before its state is
    _feed(spark, [], SNAPS, src, step)
    assert table() == whole and len(whole) == 6


def test_a_hot_device_is_spread_over_tasks(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [_snap("hot" if i % 10 else f"d{i}", i, i, i, i) for i in range(4000)]
    step = lambda s: sde.write_counter_deltas(s, str(tmp_path / "table"), str(tmp_path / "ck"), tie_cols=["tie"],
                                              num_partitions=8)
    _feed(spark, rows, SNAPS, src, step)
    out = sde.read_counter_deltas(spark, str(tmp_path / "table"))
    per_file = [r["count"] for r in out.filter("device_id = 'hot'").groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == 3600 and len(per_file) >= 6 and max(per_file) < 1200


LOGS = "run_id int, seq int, logs map<string,double>"


def _series(tmp_path, delay):
    return str(tmp_path / "in"), lambda s: sse.write_loss_series(s, str(tmp_path / "table"), str(tmp_path / "ck"), delay=delay)


@pytest.mark.parametrize("delay", [0, 7])
def test_steps_over_restarts_equal_the_batch_form(spark, tmp_path, delay):
    src, step = _series(tmp_path, delay)
    rows = [(None if i % 11 == 0 else i % 2, i, {"loss": i / 2, "eval_loss": 1.0 * i} if i % 3 else ({"loss": 1.0} if i % 2 else None))
            for i in range(60)]
    arrival = sorted(rows, key=lambda r: r[1] + (r[1] * 5 % (delay + 1)))  # up to `delay` numbers out of order
    for lo, hi in ((0, 20), (20, 21), (21, 45), (45, 60)):
        _feed(spark, arrival[lo:hi], LOGS, src, step)
    got = sse.read_loss_series(spark, str(tmp_path / "table"))
    want = lg.loss_series(spark.createDataFrame(rows, LOGS))
    assert got.filter("late").count() == 0
    assert sorted(map(str, got.drop("late").select(*want.columns).collect())) == sorted(map(str, want.collect()))
    given = sse.read_loss_series(spark, str(tmp_path / "table"), held=False)
    assert given.count() == (want.count() if delay == 0 else want.filter(F.col("seq").isin(
        [r.seq for r in given.select("seq").distinct().collect()])).count()) and given.count() > 30


def test_late_and_unnumbered_records(spark, tmp_path):
    src, step = _series(tmp_path, 2)
    _feed(spark, [(1, 10, {"loss": 1.0}), (1, 7, {"loss": 2.0}), (1, 8, {"loss": 3.0}), (1, None, {"loss": 4.0})], LOGS, src, step)
    _feed(spark, [(1, 6, {"loss": 5.0}), (1, 9, {"loss": 6.0}), (2, 1, {"loss": 7.0})], LOGS, src, step)
    got = {r.loss: (r.seq, r.step, r.late) for r in sse.read_loss_series(spark, str(tmp_path / "table")).collect()}
    assert got == {2.0: (7, 1, False), 3.0: (8, 2, False), 4.0: (None, None, None), 5.0: (6, None, True),
                   6.0: (9, 3, False), 1.0: (10, 4, False), 7.0: (1, 1, False)}
    assert {r.loss for r in sse.read_loss_series(spark, str(tmp_path / "table"), held=False).collect()} == {2.0, 3.0, 4.0, 5.0}


def test_a_hook_sees_each_record_once(spark, tmp_path):
    seen = []

    def hook(records, batch_id):
        seen.append((batch_id, sorted((r.run_id, r.seq, r.kind, r.loss) for r in records.collect())))

    src = str(tmp_path / "in")
    step = lambda s: sho.write_log_hook(s, hook, str(tmp_path / "ledger"), str(tmp_path / "ck"))
    _feed(spark, [(1, 1, {"loss": 1.0}), (1, 2, None)], LOGS, src, step)
    _feed(spark, [(1, 3, {"loss": 2.0, "eval_loss": 3.0})], LOGS, src, step)
    (tmp_path / "ck" / "commits" / "1").unlink()  # the stream replays a batch that the ledger holds
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    _feed(spark, [(None, 4, {"eval_loss": 4.0})], LOGS, src, step)
    assert seen == [(0, [(1, 1, "loss", 1.0)]), (1, [(1, 3, "eval_loss", 3.0), (1, 3, "loss", 2.0)]), (2, [(None, 4, "eval_loss", 4.0)])]
    ledger = sorted(tuple(r) for r in sho.read_ledger(spark, str(tmp_path / "ledger")).collect())
    assert ledger == [(0, "loss", 1), (1, "eval_loss", 1), (1, "loss", 1), (2, "eval_loss", 1)]


def test_a_hook_that_fails_is_called_again(spark, tmp_path):
    calls = []

    def hook(records, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("no")

    src = str(tmp_path / "in")
    step = lambda s: sho.write_log_hook(s, hook, str(tmp_path / "ledger"), str(tmp_path / "ck"))
    with pytest.raises(Exception):
        _feed(spark, [(1, 1, {"loss": 1.0})], LOGS, src, step)
    _feed(spark, [], LOGS, src, step)  # the file without rows is a micro-batch too
    assert calls == [0, 0, 1] and sho.read_ledger(spark, str(tmp_path / "ledger")).count() == 1


def test_packed_files_follow_the_bytes(spark, tmp_path):
    rows = [(f"f{i}", T0, n, bytes([i % 256]) * n, "extra") for i, n in enumerate([0, 1, 70_000, 5] + [3000] * 300)]
    rows.append(("none", T0, None, None, "extra"))
    schema = "path string, modificationTime timestamp, length long, content binary, other string"
    frames = spark.createDataFrame(rows, schema)
    sfr.pack_frames(frames, str(tmp_path / "packed"), file_bytes=100_000)
    assert len(list((tmp_path / "packed").glob("*.parquet"))) == 10  # 970 kB, not 305 frames
    back = sfr.read_packed_frames(spark, str(tmp_path / "packed"))
    assert sorted(map(str, back.collect())) == sorted(map(str, frames.drop("other").collect()))
    plan = back.select(F.sum("length"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan  # lengths are read without the contents
    sfr.pack_frames(frames.limit(0), str(tmp_path / "none"))
    assert sfr.read_packed_frames(spark, str(tmp_path / "none")).count() == 0
    stream = sfr.read_packed_frames(spark, str(tmp_path / "packed"), stream=True, maxFilesPerTrigger=4)
    q = (stream.select("path", "length").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len([p for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit()]) == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_the_latest_table_writes_changed_devices_and_merges(spark, tmp_path):
    from slmeval.streaming import latest as sl

    schema = "device_id string, ts timestamp, cpu double"
    src, table, ck = str(tmp_path / "in"), str(tmp_path / "latest"), str(tmp_path / "ck")
    step = lambda s: sl.write_latest(sl.latest_reading_stream(s, "device_id", "ts", ["cpu"]), table, ck,
                                     "device_id", "ts", compact_every=2)
    _feed(spark, [(f"d{i}", T0, 1.0 * i) for i in range(50)], schema, src, step)
    want = {f"d{i}": 1.0 * i for i in range(50)}
    for k in range(1, 7):
        if k == 4:  # the stream replays a batch whose merge was not committed
            (tmp_path / "ck" / "commits" / "3").unlink()
            (tmp_path / "ck" / "commits" / ".3.crc").unlink(missing_ok=True)
            (tmp_path / "latest" / "base" / "v3" / "_SUCCESS").unlink()
            assert {r.device_id: r.cpu for r in sl.read_latest(spark, table).collect()} == want
        late = ("d9", T0 - dt.timedelta(seconds=k), -1.0)
        _feed(spark, [(f"d{k}", T0 + dt.timedelta(seconds=k), 100.0 + k), late], schema, src, step)
        want[f"d{k}"] = 100.0 + k
        assert {r.device_id: r.cpu for r in sl.read_latest(spark, table).collect()} == want
        newest = max((tmp_path / "latest" / "delta").iterdir(), key=lambda p: int(p.name[1:]))
        assert {r.device_id for r in spark.read.parquet(str(newest)).collect()} <= {f"d{k}", "d9"}  # not the whole table
    assert sorted(p.name for p in (tmp_path / "latest" / "base").iterdir()) == ["v3", "v5"]
    assert sorted(p.name for p in (tmp_path / "latest" / "delta").iterdir()) == ["v3", "v4", "v5", "v6"]
