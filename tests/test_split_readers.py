import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from slmeval.sources import blocks, split_csv, split_json
from slmeval.sources import items as si

MARKS = ["a", "b", '"', ",", "\n", "\r\n", "\r", "}", "{", "[", "]", "\\", '\\"', " ", "é", '""', "😀"]


@pytest.fixture
def splits(spark):
    """Set the size of input splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield use
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def rows_of(seed, n=300):
    rnd = random.Random(seed)
    return [(str(i), "".join(rnd.choices(MARKS, k=rnd.randint(0, 30))), rnd.choice(["x", "", "  ", "nan"])) for i in range(n)]


def tasks(spark, path):
    return spark.read.text(str(path)).select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("size", [1 << 20, 3000, 997, 60])
@pytest.mark.parametrize("broadcast", [True, False])
def test_csv_at_any_split(spark, tmp_path, splits, monkeypatch, size, broadcast):
    if not broadcast:
        monkeypatch.setattr(blocks, "MAX_BROADCAST", 0)
    rows = rows_of(size, 300 if size > 100 else 60)
    with open(tmp_path / "a.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "te,xt", "m"])
        w.writerows(rows)
    splits(size)
    assert size > 10_000 or tasks(spark, tmp_path / "a.csv") > 3
    got = split_csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "te,xt", "m"]
    assert sorted((r[0], r[1] or "", r[2] or "") for r in got.collect()) == sorted(rows)


def test_csv_equals_the_multiline_reader(spark, tmp_path, splits):
    rows = [(i, t.replace("\r", ""), m) for i, t, m in rows_of(3)]  # Spark's reader rewrites carriage returns
    with open(tmp_path / "a.csv", "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "t", "m"])
        w.writerows(rows)
    splits(800)
    whole = spark.read.csv(str(tmp_path / "a.csv"), header=True, multiLine=True, escape='"')
    assert sorted(map(str, split_csv.read_csv(spark, str(tmp_path / "a.csv")).collect())) == sorted(map(str, whole.collect()))


def test_csv_files_headers_and_folders(spark, tmp_path, splits):
    texts = {"k=1/a.csv": 'x,y\n1,"p\nq"\n', "k=1/b.csv": 'y,z\r\n"p\r\nq",2\r\n\r\n3\r\n', "k=2/c.csv": "x,y\n", "k=2/d.csv": "",
             "k=2/e.csv": 'x,y\n5,"open\n6,7\n'}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    for size in (1 << 20, 7):
        splits(size)
        got = split_csv.read_csv(spark, str(tmp_path))
        assert set(got.columns) == {"x", "y", "z", "k"}
        assert sorted((r.x or "", r.y or "", r.z or "", r.k) for r in got.collect()) == [
            ("", "3", "", 1), ("", "p\r\nq", "2", 1), ("1", "p\nq", "", 1), ("5", "open\n6,7", "", 2)]
    (tmp_path / "k=1" / "b.csv").write_text('"a\nb",c\n1,2\n')
    with pytest.raises(ValueError, match="header"):
        split_csv.read_csv(spark, str(tmp_path))


@pytest.mark.parametrize("size", [1 << 20, 3000, 997, 60])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_at_any_split(spark, tmp_path, splits, size, indent):
    items = [{"id": i, "t": t, "n": {"k": [1, {"z": m}, []], "": {}}} for i, t, m in rows_of(size + 1, 200 if size > 100 else 40)]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=indent, ensure_ascii=bool(indent)))
    splits(size)
    assert size > 10_000 or tasks(spark, tmp_path / "a.json") > (3 if indent else 0)
    found = [json.loads(r.value) for r in split_json.read_array_items(spark, str(tmp_path / "a.json")).collect()]
    assert sorted(found, key=lambda x: int(x["id"])) == items
    lengths = split_json.read_array_items(spark, str(tmp_path / "a.json")).agg(F.max(F.length("value"))).scalar()
    assert spark.range(1).select(lengths).first()[0] < 400  # texts of items, never of files


@pytest.mark.parametrize("size", [1 << 20, 5])
def test_json_edges(spark, tmp_path, splits, size):
    splits(size)

    def read(*texts):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for i, t in enumerate(texts):
            (folder / f"{i}.json").write_text(t)
        return sorted(r.value for r in split_json.read_array_items(spark, str(folder)).collect())

    assert read("[]", "", " [ ] \n", "[\n]") == []
    assert read("[{}]", '[ {"a": "}"} , {"b": "]\\\\"}\n]\n') == ['{"a": "}"}', '{"b": "]\\\\"}', "{}"]
    for wrong in ('[{"a": 1}, 2, {"a": 3}]', '[[{"a": 1}]]', '{"a": 1}', '[{"a": 1}', '[{"a": 1} {"a": 2}]', '[{"a": 1}] x', "[1]", '[{"a": 1}]]'):
        with pytest.raises(Exception, match="not an array of objects"):
            read(wrong)


def test_other_splits_fail_the_read(spark, tmp_path, splits):
    rows = rows_of(8)
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f).writerows([("id", "t", "m"), *rows])
    splits(900)
    planned = split_csv.read_csv(spark, str(tmp_path / "a.csv"))
    splits(700)
    with pytest.raises(Exception, match="split in another way"):
        planned.collect()


def test_items_written_as_arrays_read_back(spark, tmp_path, splits):
    df = spark.createDataFrame([(i, t, None if i % 7 else "a") for i, (_, t, _) in enumerate(rows_of(5))], "k long, question string, answer string")
    si.write_items(df.repartition(3).union(df.limit(0)), str(tmp_path / "out"))
    for p in (tmp_path / "out").glob("part-*"):
        json.loads(p.read_text())
    splits(500)
    back = si.read_items(spark, str(tmp_path / "out"), fields=("k", "question", "answer"), required=("question", "answer"))
    assert sorted((int(r.k), r.question, r.answer) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_text_taken_up_at_once_is_bounded(monkeypatch):
    import pyarrow as pa

    n, size = 50, 100_000
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 30 + [2] * 20), pa.array([0] * n), pa.array(["x" * size] * n)], names=["f", "s", "value"])
    runs = list(blocks._runs(batch))
    assert [a for a, _ in runs] == [0, *[b for _, b in runs[:-1]]] and runs[-1][1] == n and 30 in [b for _, b in runs]
    assert max(b - a for a, b in runs) * size <= blocks.RUN_BYTES + size
    # the same records whatever is taken up at once
    text = json.dumps([{"a": f'{i} "}}]' + "\\" * (i % 3), "b": [{"c": i}]} for i in range(200)])
    values = pa.array(text.split("}"))
    rows = pa.RecordBatch.from_arrays([pa.array([7] * len(values)), pa.array([0] * len(values)), pa.array([0] * len(values)),
                                       pa.array([0] * len(values)), values], names=["f", "s", "s0", "s1", "value"])
    found = []
    for size in (1 << 20, 50, 1):
        monkeypatch.setattr(blocks, "RUN_BYTES", size)
        found.append([r for b in blocks._cut(split_json._advance, "}", 2, None)(iter([rows])) for r in b.select(["first", "closed", "text"]).to_pylist()])
    assert len(found[0]) == 201 and found[0] == found[1] == found[2]
