import csv
import json
import math

import pytest

from slmeval.sources import frames as sfr
from slmeval.sources import items as si
from slmeval.sources import runs as sr
from slmeval.sources import telemetry as st


def test_read_items_json_array(spark, tmp_path):
    items = [{"scenario": "Rain, heavy", "question": "Speed \"limit\"?", "answer": "007"},
             {"scenario": "Fog", "question": "Lights?"}]
    p = tmp_path / "items.json"
    p.write_text(json.dumps(items, indent=1))
    rows = {r.scenario: r for r in si.read_items(spark, str(p)).collect()}
    assert rows["Rain, heavy"].answer == "007" and rows["Fog"].answer is None  # text stays text
    (tmp_path / "lines").write_text("\n".join(json.dumps(x) for x in reversed(items)))
    again = si.read_items(spark, str(tmp_path / "lines"), multi_line=False).collect()
    assert {r.scenario: r.item_id for r in again} == {k: r.item_id for k, r in rows.items()}  # whatever the layout


@pytest.mark.parametrize("multi_line", [True, False])
def test_required_means_the_key(spark, tmp_path, multi_line):
    def read(items):
        p = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        p.write_text(json.dumps(items) if multi_line else "\n".join(map(json.dumps, items)))
        return si.read_items(spark, str(p), required=("scenario", "question"), multi_line=multi_line)

    ok = read([{"scenario": "s", "question": None, "answer": "a"}, {"scenario": "t", "question": "q", "more": 1}])
    assert sorted((r.scenario, r.question, r.answer) for r in ok.collect()) == [("s", None, "a"), ("t", "q", None)]
    with pytest.raises(Exception, match="question"):
        read([{"scenario": "s"}]).select("scenario").collect()


def test_files_with_different_headers_are_read_by_name(spark, tmp_path):
    for label, head, row in (("A", "answer,ram_before,ram_after,cpu_usage,inference_time", "x,1,2,3,4"),
                             ("B", "answer,latency,cpu_usage,ram_after,ram_before", "y,4,3,2,1")):
        (tmp_path / f"label={label}").mkdir()
        (tmp_path / f"label={label}" / "r.csv").write_text(f"{head}\n{row}\n")
    rows = sr.read_labelled_runs(spark, str(tmp_path)).collect()
    assert sorted((r.label, r.answer, r.ram_before, r.ram_after, r.cpu_usage, r.inference_time) for r in rows) == [
        ("A", "x", 1.0, 2.0, 3.0, 4.0), ("B", "y", 1.0, 2.0, 3.0, 4.0)]


def test_csv_written_by_python_reads_back(spark, tmp_path):
    answers = ['say "stop", then go', "line\rbreak", "back\\\"slash", "", "NA"]
    p = tmp_path / "runs.csv"
    with open(p, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["answer", "ram_before", "ram_after", "cpu_usage", "latency"])
        for i, a in enumerate(answers):
            w.writerow([a, 1.5, 2.5, float("nan") if i == 0 else 3.0, "NA" if i == 1 else 0.25])
    rows = sr.read_runs(spark, str(p)).collect()
    assert [r.answer if r.answer is not None else "" for r in rows] == answers
    assert "inference_time" in rows[0].asDict()  # latency renamed
    assert math.isnan(rows[0].cpu_usage) and rows[1].inference_time is None


def test_write_and_read_labelled(spark, tmp_path):
    df = spark.createDataFrame([("A", "x, \"y\"", 1.0, 2.0, 3.0, 4.0), ("B", "z", 5.0, 6.0, 7.0, 8.0)],
                               "label string, answer string, ram_before double, ram_after double, cpu_usage double, inference_time double")
    path = str(tmp_path / "out")
    sr.write_runs(df, path)
    back = {r.label: r for r in sr.read_labelled_runs(spark, path).collect()}
    assert back["A"].answer == 'x, "y"' and back["B"].inference_time == 8.0
    by_map = sr.read_labelled_runs(spark, {"A": f"{path}/label=A", "B": f"{path}/label=B"})
    assert sorted(r.label for r in by_map.collect()) == ["A", "B"]


def test_parse_recorded_readings(spark):
    lines = spark.createDataFrame([
        ("2024-01-01T00:00:00 dev1 cpu  10 0 5 100 7 0 1 0 0 0",),
        ("2024-01-01T00:00:00 dev1 Mem:  7919  2000  3000  10  2909  5500",),
        ("garbage",),
    ], "value string")
    c = st.parse_counter_lines(lines).collect()
    assert len(c) == 1 and list(c[0].counters) == [10, 0, 5, 100, 7, 0, 1, 0, 0, 0] and c[0].device_id == "dev1"
    m = st.parse_memory_lines(lines).collect()
    assert len(m) == 1 and m[0].total_mb == 7919 and m[0].available_mb == 5500


def test_frames_from_files(spark, tmp_path):
    for i, payload in enumerate([b"\x00" * 5000, bytes(range(256)) * 20, b""]):
        (tmp_path / f"f{i}.bin").write_bytes(payload)
    # Spark gives no row for an empty file
    frames = sfr.read_frames(spark, str(tmp_path), glob="*.bin").collect()
    assert sorted(f.length for f in frames) == [5000, 5120] and all(len(f.content) == f.length for f in frames)


def test_item_arrays_are_bounded_whatever_a_conversation(spark, tmp_path, monkeypatch):
    from slmeval.plans import queries as q

    rows = [(7 if i % 3 else i, i, "user", f"question {i}") for i in range(5000)] + [(None, None, None, None)] * 3000
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        str(tmp_path / "sf" / "conversations.parquet"))
    monkeypatch.setattr(q, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = q.QUERIES["items_json_array"](spark, str(tmp_path / "sf")).collect()
    lengths = [len(json.loads(p.read_text())) for p in (tmp_path / "items-array").glob("part-*")]
    assert sum(lengths) == 8000 and max(lengths) <= 1024
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(key((r.conv_id, r.turn)) for r in got) == sorted(key(r[:2]) for r in rows)


def test_folders_of_frames_follow_the_tasks(spark, tmp_path, monkeypatch):
    import hashlib

    from slmeval.plans import queries as q

    rows = [(i, f"<p>é\n{i}</p>" * (i % 5)) for i in range(40)] + [(3, "again"), (-(1 << 63), "\n1\n"), (None, "lost"), (50, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    monkeypatch.setattr(q, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(q, "FRAME_FILES", 15, raising=False)
    got = sorted(map(tuple, q.QUERIES["read_frames"](spark, str(tmp_path / "sf")).collect()), key=str)
    data = [(i, (h or "").encode()) for i, h in rows]
    assert got == sorted(((i, len(h), hashlib.md5(h).hexdigest()) for i, h in data), key=str)
    frames = tmp_path / "frames"
    assert len([p for p in frames.iterdir() if p.is_dir()]) <= 3 and len([p for p in frames.glob("*/*") if p.name[0] != "."]) == len(rows)
