import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slmeval.llm import suffix_tree as st
from slmeval.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
RND = random.Random(4)


def tokens(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")] + [None]


def base(rows, train):
    counts = Counter(t for d, x in rows if train(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return {d: (len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n,
                sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x))) for d, x in rows}


def check(got, rows, train):
    expected = base(rows, train)
    assert len(got) == len(rows)
    for r in got:
        n_tokens, n_known, n, score = expected[r.id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(score, abs=1e-9 * n_tokens)


def test_words_over_many_blocks(spark):
    vocabulary = ["Abc", "abc", "ABC", "éÉ", "ß", "x" * 500, " ", "zz"] + [f"w{i}" for i in range(200)]
    rows = [(i, RND.choice([" ", "\n", "\t \x0b"]).join(RND.choices(vocabulary, k=RND.randint(0, 60)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, "  "), (153, "word " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x"))
    for blocks in (10**9, 5000):
        got = st.score_documents(df, F.col("doc_id") % 3 != 0, block_chars=blocks).collect()
        check(got, rows, lambda d: d % 3 != 0)


def test_no_training_rows_and_empty(spark):
    rows = [(1, "a b"), (2, None), (None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = st.score_documents(df, F.lit(None).cast("boolean")).collect()
    assert {(r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {
        (1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0), (None, 2, 0, 0, 0.0)}
    assert {r.id: r.score for r in got}[1] == pytest.approx(-4 * math.log10(st.ALPHABET))
    assert st.score_documents(df.limit(0), F.lit(True)).count() == 0


def windows_of(text):
    s = [st.START] * st.DEPTH + list(" ".join(t for t in tokens(text) if t).encode()) + [st.END]
    return [tuple(s[i - st.DEPTH : i + 1]) for i in range(st.DEPTH, len(s))]


def test_windows_and_word_hashes():
    texts = ["Ab  c\n", "", None, "é" * 40, " x "]
    expected = [int.from_bytes(bytes(w), "big") for t in texts for w in windows_of(t)]
    assert st.windows(st.symbols(texts)[0])[0].tolist() == expected
    h, n = st.word_hashes([*texts, "AB c \té" + "é" * 39])
    assert n.tolist() == [2, 0, 0, 1, 1, 3] and h[0] == h[4] and h[1] == h[5] and h[2] == h[6] and len(set(h.tolist())) == 4


def plain_tree(texts, p_min, least):
    """The retained contexts and their smoothed distributions by direct definition."""
    grams = Counter(w for t in texts for w in windows_of(t))
    total = sum(grams.values())
    counts = {}
    for w, n in grams.items():
        for k in range(st.DEPTH + 1):
            counts.setdefault(w[st.DEPTH - k : st.DEPTH], Counter())[w[-1]] += n
    counts = {c: x for c, x in counts.items() if sum(x.values()) >= max(1, p_min * total)}

    def prob(c, s):
        if c is None:
            return 1 / st.ALPHABET
        x = counts[c]
        return (x[s] + len(x) * prob(c[1:] if c else None, s)) / (sum(x.values()) + len(x))

    passed = {c for c, x in counts.items() if not c or sum(
        n / sum(x.values()) * math.log(n / sum(x.values()) / prob(c[1:], s)) for s, n in x.items()) >= least}
    kept = {c[i:] for c in passed for i in range(len(c) + 1)} | ({()} if counts else set())

    def score(text):
        out = 0.0
        for w in windows_of(text):
            state = next((w[i:-1] for i in range(st.DEPTH + 1) if w[i:-1] in kept), None)
            out += math.log10(prob(state, w[-1]))
        return out

    return score, kept


@pytest.mark.parametrize("p_min,least", [(1e-9, 0.0), (0.002, 0.05), (0.01, 0.3)])
def test_tree_equals_definition(spark, p_min, least):
    texts = [" ".join(RND.choices(["the", "then", "these", "a", "an", "été"], k=RND.randint(1, 30))) for _ in range(80)]
    score, kept = plain_tree(texts, p_min, least)
    candidates = st.context_counts(spark.createDataFrame([(t,) for t in texts], "text string"), p_min).toPandas()
    tree = st.fit_tree(candidates, least)
    assert sum(len(level[2]) for level in tree.levels) == len(kept)
    probes = [*texts[:20], "", None, "unseen words here", "the the", "漢字"]
    scorer = st.Scorer(tree)
    for _ in range(2):  # the second time from the table
        assert scorer(probes) == pytest.approx([score(t) for t in probes])


def test_empty_tree():
    tree = st.fit_tree(pd.DataFrame({"length": [], "code": [], "n": [], "total": []}))
    assert st.Scorer(tree)(["ab"]) == pytest.approx(np.array([-3 * math.log10(st.ALPHABET)]))


def test_query_equals_brute_force_and_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    train = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    got = QUERIES["op8_suffix_tree_lm"](spark, sf).withColumnRenamed("doc_id", "id").collect()
    check(got, rows, train)
    assert all(r.held_out != train(r.id) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_contexts_are_not_cut_by_a_share_of_the_corpus(spark):
    texts = ["the then " * 80000] * 3 + ["quartz vex"] * 2  # 2e-6 of the symbols is more than 4
    total = sum(len(windows_of(t)) for t in set(texts[:3])) * 3 + 22
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, "a quartz vex")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score, kept = plain_tree(texts, 2 / total, st.MIN_DIVERGENCE)
    assert tuple(b"quart") in kept
    for blocks in (10**9, 300_000):
        got = {r.id: r.score for r in st.score_documents(df, F.col("doc_id") < 9, block_chars=blocks).collect()}
        assert got == pytest.approx({i: score(t) for i, t in rows}, abs=1e-6)


def test_table_and_blocks_score_as_the_gathered_tree(spark):
    texts = [" ".join(RND.choices(["the", "then", "these", "été", "漢字", "x"], k=RND.randint(0, 30))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [(t,) for i, t in enumerate(texts) if i % 4]
    tree = st.fit_tree(st.context_counts(spark.createDataFrame(train, "text string"), min_count=st.MIN_COUNT).toPandas())
    expected = st.Scorer(tree)(texts)
    for blocks in (10**9, 500):
        got = {r.id: r.score for r in st.score_documents(df, F.col("doc_id") % 4 != 0, block_chars=blocks).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(list(expected))


def test_packed_codes():
    codes = np.unique(np.array([RND.getrandbits(48) for _ in range(3000)], dtype=np.uint64))
    for some in (codes, codes[:1], codes[:0]):
        assert np.array_equal(np.sort(st.unpack(st.pack(some))), some)


def test_packed_scores():
    rng = np.random.RandomState(3)
    for scores in (rng.rand(70_000), np.repeat(rng.rand(300), 50), np.array([-1.5]), np.empty(0), np.array([0.0, -np.inf, 0.0])):
        assert np.array_equal(st.unpack_scores(st.pack_scores(scores)), scores)


def test_requests_of_a_bucket_are_dealt_and_streamed(spark, monkeypatch):
    texts = [" ".join(RND.choices(["the", "then", "these", "été", "漢字", "x"], k=RND.randint(0, 30))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = st.fit_tree(st.context_counts(df.filter("doc_id % 4 <> 0").select("text"), min_count=st.MIN_COUNT).toPandas())
    monkeypatch.setattr(st, "MAX_BUCKETS", 2)
    monkeypatch.setattr(st, "LOOK_UP_BYTES", 100)
    seen, look_up = [], st.look_up_windows
    monkeypatch.setattr(st, "look_up_windows", lambda a, b, c, salts: (seen.append(salts), look_up(a, b, c, salts))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups that span batches
    try:
        got = {r.id: r.score for r in st.score_documents(df, F.col("doc_id") % 4 != 0, block_chars=300).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] > 1
    assert [got[i] for i in range(len(texts))] == pytest.approx(list(st.Scorer(tree)(texts)))


def test_rows_of_one_id_or_none(spark):
    rows = [(None, f"some words {i}") for i in range(40)] + [(7, f"more words {i}") for i in range(40)] + [(1, "the same")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = st.score_documents(df, F.lit(True), block_chars=100).collect()
    alone = st.score_documents(df, F.lit(True)).collect()
    values = lambda rows: sorted((r.id or 0, r.n_tokens, r.n_known, round(r.score, 6), round(r.base_score, 6)) for r in rows)
    assert values(got) == values(alone)
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {40 * 4 + 40 * 4 + 30 * 3}


def test_packed_words():
    words = np.unique(np.array([RND.getrandbits(64) for _ in range(5000)], dtype=np.uint64)).view(np.int64)
    counts = np.array([RND.choice([1, -1, 7, -(10**12)]) for _ in words])
    for n in (len(words), 1):
        got = dict(zip(*(x.tolist() for x in st.unpack_words(st.pack_words(words[:n].view(np.uint64), counts[:n])))))
        assert got == dict(zip(words[:n].tolist(), counts[:n].tolist()))
