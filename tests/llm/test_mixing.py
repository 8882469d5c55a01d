import random
import re
from collections import Counter

import pytest

from slmeval.llm import mixing
from slmeval.llm.queries import QUERIES

RND = random.Random(2)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Reshare the excess by weight until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        if not open_:
            return capped
        unit = (total - sum(capped.values())) / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > 3 * sizes[s]]
        if not above:
            return capped | {s: unit * weight[s] for s in open_}
        capped |= {s: 3.0 * sizes[s] for s in above}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def rows_of(sources):
    rows, i = [], 0
    for source, n in sources.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * RND.randint(0, 90)) + RND.choice(["", "\n", "\t "]), source))
            i += 1
    return rows


def check(rows, got, near):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target, taken = plain_targets(dict(sizes)), Counter()
    assert len(got) == len(rows)
    source = {d: s for d, _, s in rows}
    text = {d: t for d, t, _ in rows}
    for r in got:
        assert r.size == len(WORD.findall(text[r.id] or "")) and r.source_size == sizes[source[r.id]]
        assert r.target == pytest.approx(target[source[r.id]]) and 0 <= r.taken <= 3 * r.size
        taken[source[r.id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near, (s, taken[s], target[s])


def test_targets_and_words_taken(spark):
    rows = rows_of({"a": 300, "b": 40, "c": 2, "é": 30, "z": 25, None: 30, "Z": 1})
    got = mixing.mix(frame(spark, rows), shard_words=10**9).collect()
    check(rows, got, 1)
    again = mixing.mix(frame(spark, rows).repartition(7), shard_words=10**9).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards(spark):
    rows = rows_of({"a": 400, "b": 60, "c": 90})
    got = mixing.mix(frame(spark, rows), shard_words=500).collect()
    shards = max(-(-sum(len(WORD.findall(t)) for _, t, x in rows if x == s) // 500) for s in "abc")
    check(rows, got, shards)
    check(rows, mixing.mix(frame(spark, rows), shard_words=500, block_words=1).collect(), shards)


def plain_sainte_lague(aims, seats):
    quota = dict.fromkeys(aims, 0)
    for _ in range(seats):
        quota[max(aims, key=lambda c: (aims[c] / (2 * quota[c] + 1), -c))] += 1
    return quota


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_equals_the_quotient_rule(spark, seed):
    rnd = random.Random(seed)
    aims = {i: rnd.choice([0.0, rnd.random(), 100 * rnd.random(), 5000 * rnd.random()]) for i in range(40)}
    cells = spark.createDataFrame([(i, a, 10**9) for i, a in aims.items()], "i int, aim double, most long")
    for seats in (0, 1, 17, 400, 3001):
        got = {r.i: r.quota for r in mixing.apportion(cells, seats, "aim", "most", ["i"]).collect()}
        assert got == plain_sainte_lague(aims, seats)


def test_ties_go_by_order(spark):
    cells = spark.createDataFrame([(i, 1.0, 10) for i in range(4)], "i int, aim double, most long")
    got = {r.i: r.quota for r in mixing.apportion(cells, 6, "aim", "most", ["i"]).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 3: 1}


def test_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = [(1, None, "a"), (2, "", None), (3, " \n", "b")]
    assert {(r.size, r.target, r.taken) for r in mixing.mix(frame(spark, rows)).collect()} == {(0, 0.0, 0)}
    rows = [(1, "one word more", "a"), (1, "one word more", "a"), (None, "x " * 50000, "a")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == 3 and sum(r.taken for r in got) == 50006


def test_small_sources_take_their_words(spark):
    rows = [(i, "one two three four five", f"s{i:03}") for i in range(200)]
    got = mixing.mix(frame(spark, rows)).collect()
    check(rows, got, 1)
    assert sum(r.taken for r in got) == 1000
    kept = mixing.mixed_documents(frame(spark, rows))
    assert 150 <= kept.count() <= 250 and len({r.source for r in kept.collect()}) >= 130
    rows = [(1, "w " * 10, "a")]
    (r,) = mixing.mix(frame(spark, rows)).collect()
    assert (r.target, r.taken) == (10.0, 10) and mixing.mixed_documents(frame(spark, rows)).count() == 1


def test_words_of_full_shards_are_passed_on(spark):
    cells = spark.createDataFrame([("a", 0, 10, 90.0), ("b", 0, 200, 100.0), ("c", 0, 3, 23.0)], "source string, shard long, cell long, aim double")
    got = {r.source: r.words for r in mixing.shard_quotas(cells, 213).collect()}
    assert got["a"] == 30 and got["c"] == 9 and sum(got.values()) == 213


def test_documents_without_words_stay_out_of_the_rings(spark):
    rows = [(i, "" if i % 3 else " \n", "a") for i in range(500)] + [(i, "w " * (i % 40), "b") for i in range(500, 600)]
    got = mixing.mix(frame(spark, rows), shard_words=300).collect()
    assert len(got) == 600 and all(r.taken == 0 for r in got if r.size == 0)
    assert sum(r.taken for r in got) == sum(r.size for r in got)


def test_mixed_documents_keep_columns(spark):
    rows = [(i, " ".join(["w"] * 50), "abc"[i % 3], i, "x") for i in range(90)] + [(90, None, "a", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, Size string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    counts = Counter(r.doc_id for r in out.collect())
    by_source = Counter({s: sum(n for d, n in counts.items() if rows[d][2] == s and d < 90) for s in "abc"})
    assert counts[90] == 1
    assert [abs(by_source[s] - w * 15) <= 1 for s, w in zip("abc", (1, 2, 3))] == [True] * 3


def test_native_plan_and_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op7_source_mixing"](spark, sf)
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())
    check(rows, found.withColumnRenamed("doc_id", "id").collect(), 1)
