import numpy as np

from slmeval.operators import logs as lg
from slmeval.operators import vectors as vc


def test_quantize_cases(spark):
    rows = [(0, [0.0, 0.0]), (1, [0.3]), (2, [127.0, 0.5, 1.5, -2.5]), (3, [-4.0, 1.0, 2.0]), (4, [0.1, -0.7, 0.33])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    out = {r.id: r for r in vc.quantize_int8(df, "v").withColumn("dq", vc.dequantize_int8("q", "scale")).collect()}
    assert list(out[0].q) == [0, 0] and out[0].scale == 0.0  # zero vector
    assert list(out[1].q) == [127]  # one element
    assert list(out[2].q) == [127, 0, 2, -2]  # exact half steps round to even
    assert list(out[3].q) == [-127, 32, 64]  # negative maximum
    for r in out.values():
        v = np.array(rows[r.id][1], dtype=np.float32).astype(np.float64)
        assert np.all(np.abs(np.array(r.dq) - v) <= r.scale / 2 + 1e-12)


def test_vector_stats(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0, -1.0],)], "v array<float>")
    r = vc.vector_stats(df, "v").first()
    assert r.argmax == 1 and r.mean == 2.5


def test_loss_series_cases(spark):
    rows = [(1, 1, None), (1, 2, {}), (1, 3, {"loss": 2.0, "eval_loss": 3.0}), (1, 4, {"epoch": 1.0}),
            (1, 5, {"loss": 1.5}), (2, 1, {"eval_loss": 9.0})]
    df = spark.createDataFrame(rows, "run_id int, seq int, logs map<string,double>")
    got = sorted(tuple(r) for r in lg.loss_series(df, num_partitions=2).collect())
    assert got == [(1, "eval_loss", 1, 3, 3.0), (1, "loss", 1, 3, 2.0), (1, "loss", 2, 5, 1.5), (2, "eval_loss", 1, 1, 9.0)]
