import pytest
from pyspark.sql import functions as F

from slmeval.operators import split as sp


@pytest.mark.parametrize("n", [0, 1, 2, 5, 99])
def test_exact_sizes_disjoint_complete(spark, n):
    df = spark.range(n).withColumn("content", F.lit("same text"))  # equal content, different id
    train, ev = sp.train_eval(df, "id", 0.8, 42)
    t = sorted(r.id for r in train.collect())
    e = sorted(r.id for r in ev.collect())
    assert len(t) == round(0.8 * n)
    assert not set(t) & set(e) and sorted(t + e) == list(range(n))
    t2 = sorted(r.id for r in sp.train_eval(df, "id", 0.8, 42)[0].collect())
    assert t == t2  # deterministic


def test_split_equals_global_ranking(spark):
    df = spark.range(2000)
    flagged = sp.split_exact(df, "id", 0.8, 7, prefix_bits=4)  # few groups: boundary group is large
    got = {r.id for r in flagged.filter("in_train").collect()}
    import hashlib

    ranked = sorted(range(2000), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    assert got == set(ranked[:1600])


def test_remainder_keeps_content_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, t string")
    sub = df.filter("id = 1")
    assert sorted(r.id for r in sp.remainder(df, sub, "id").collect()) == [2, 3]


def test_number_runs_and_batches(spark):
    df = spark.createDataFrame([(i, f"k{i:03d}") for i in range(10)], "id long, k string")
    nr = sorted((r.id, r.run_no) for r in sp.number_runs(df, ["k"], num_partitions=4).collect())
    assert nr == [(i, i + 1) for i in range(10)]
    b = sorted((r.batch_id, list(r.ids)) for r in sp.make_batches(df, ["k"], "id", 3).collect())
    assert b == [(0, [0, 1, 2]), (1, [3, 4, 5]), (2, [6, 7, 8]), (3, [9])]


def test_split_is_a_filterable_flag(spark):
    plan = sp.split_exact(spark.range(5000), "id", 0.8, 42)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("ids", [[1, 2, None, 3], [1, 2, 2], [None] * 5])
def test_ids_that_cannot_give_an_exact_size_fail(spark, ids):
    with pytest.raises(ValueError, match="unique ids"):
        sp.split_exact(spark.createDataFrame([(i,) for i in ids], "id long"), "id")
