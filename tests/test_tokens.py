from pyspark.sql import functions as F

from slmeval.functions import arrays as ar
from slmeval.operators import tokens as tk


def _texts(spark):
    rows = [(0, ""), (1, "one"), (2, " ".join(["w"] * 127)), (3, " ".join(["w"] * 128)), (4, " ".join(["w"] * 129)),
            (5, "<|endoftext|> real eos text")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_word_encoding_lengths_and_masks(spark):
    df = _texts(spark)
    vocab = tk.build_vocabulary(df, "text", 50)
    enc = {r.doc_id: r for r in tk.encode_words(df, "doc_id", "text", vocab).collect()}
    expected_n = {0: 0, 1: 1, 2: 127, 3: 128, 4: 129}
    for k, n in expected_n.items():
        r = enc[k]
        assert r.n_tokens == n
        assert len(r.input_ids) == 128 and len(r.attention_mask) == 128
        assert sum(r.attention_mask) == min(n, 128)
        assert all(x == tk.WORD_EOS_ID for x in r.input_ids[min(n, 128):])
    lab = df.sparkSession.createDataFrame([([5, 0, 0],)], "ids array<int>").select(tk.causal_labels("ids", 0)).first()[0]
    assert list(lab) == [5, -100, -100]


def test_vocabulary_ranking(spark):
    df = spark.createDataFrame([(1, "b a a c c c")], "doc_id long, text string")
    v = {r.token: r.token_id for r in tk.build_vocabulary(df, "text", 2).collect()}
    assert v == {tk.WORD_EOS: 0, tk.WORD_UNK: 1, "c": 2, "a": 3}


def test_repeated_keys_nulls_and_large_vocabulary(spark, monkeypatch):
    rows = [(1, "a b c"), (1, "d e"), (None, "a"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = tk.build_vocabulary(df, "text")
    assert {r.token: r.token_id for r in vocab.collect()} == {tk.WORD_EOS: 0, tk.WORD_UNK: 1, "a": 2, "b": 3, "c": 4, "d": 5, "e": 6}
    expected = [(1, 2, [5, 6, 0, 0]), (1, 3, [2, 3, 4, 0]), (2, 0, [0] * 4), (3, 0, [0] * 4), (None, 1, [2, 0, 0, 0])]
    for entries, size in ((tk.MAX_BROADCAST_ENTRIES, tk.MAX_BROADCAST_BYTES), (3, tk.MAX_BROADCAST_BYTES), (100, 10)):
        # broadcast; joined by key for the rows or the bytes of the vocabulary
        monkeypatch.setattr(tk, "MAX_BROADCAST_ENTRIES", entries)
        monkeypatch.setattr(tk, "MAX_BROADCAST_BYTES", size)
        got = [(r.doc_id, r.n_tokens, list(r.input_ids)) for r in tk.encode_words(df, "doc_id", "text", vocab, 4).collect()]
        assert sorted(got, key=str) == expected
        ids = tk.lookup_words(df.union(spark.createDataFrame([(9, "a zz b")], df.schema)), "doc_id", "text", vocab)
        assert {r.doc_id: r.ids for r in ids.collect()}[9] == [2, 1, 3]
        words = tk.decode_words(ids.filter("doc_id = 9").withColumn("ids", ar.append_token("ids", 77)), "doc_id", "ids", vocab)
        assert words.first().text == f"a {tk.WORD_UNK} b {tk.WORD_UNK}"


def test_row_wise_lookup_has_no_shuffle(spark):
    df = _texts(spark)
    plan = tk.encode_words(df, "doc_id", "text", tk.build_vocabulary(df, "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_training_table(spark):
    df = spark.createDataFrame([(i, f"t{i} x") for i in range(10)] + [(10, None)], "doc_id long, text string")
    t = tk.training_table(df, "doc_id", "text", tk.build_vocabulary(df, "text"), max_length=4)
    rows = t.collect()
    assert sum(r.in_train for r in rows) == round(0.8 * 11) and all(len(r.input_ids) == 4 for r in rows)
    assert all([x if x else -100 for x in r.input_ids] == list(r.labels) for r in rows)
    assert tk.select_model_inputs(t.filter("in_train")).columns == ["input_ids", "attention_mask"]


def test_truncate_at_eos_cases(spark):
    rows = [([9, 1, 2], 1), ([0, 5, 6], 1), ([3, 4, 5], 1), ([1, 1, 9], 1), ([], 1)]
    df = spark.createDataFrame([(i, a, m) for i, (a, m) in enumerate(rows)], "i int, ids array<int>, m int")
    got = {r.i: list(r.t) for r in df.select("i", ar.truncate_at_eos("ids", 9, 3).alias("t")).collect()}
    assert got[0] == [9]  # EOS at the first step is kept, nothing after it
    assert got[2] == [3, 4, 5]  # never: cut at the limit
    assert got[3] == [1, 1, 9]  # EOS exactly at the limit
    assert got[4] == []
    zero = df.select(ar.truncate_at_eos("ids", 9, 0).alias("t")).collect()
    assert all(list(r.t) == [] for r in zero)  # max_new_tokens = 0


def test_array_helpers(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0], [7, 8, 9, 10])], "v array<double>, ids array<int>")
    r = df.select(ar.argmax_index("v").alias("a"), ar.array_mean("v").alias("m"), ar.new_tokens("ids", 2).alias("n"),
                  ar.new_tokens("ids", 9).alias("e"), ar.strip_special_tokens("ids", [8]).alias("s"),
                  ar.append_token("ids", 11).alias("p"), ar.close_loop("ids").alias("c")).first()
    assert r.a == 1 and r.m == 2.25 and list(r.n) == [9, 10] and list(r.e) == [] and list(r.s) == [7, 9, 10]
    assert list(r.p) == [7, 8, 9, 10, 11] and list(r.c) == [7, 8, 9, 10, 7]


def test_null_and_unknown_elements(spark, monkeypatch):
    table = spark.createDataFrame([("a", 5), ("b", None), ("é", 7)], "k string, v int")
    rows = [(1, ["a", None, "b", "é", "z"] * 3), (2, []), (3, None), (4, ["é"])]
    df = spark.createDataFrame(rows, "id int, x array<string>").repartition(1)
    for size in (tk.MAX_BROADCAST_BYTES, -1):
        monkeypatch.setattr(tk, "MAX_BROADCAST_BYTES", size)
        got = {r.id: r.y for r in tk._mapped_array(df, F.col("x"), table, "k", "v", -1, "y").collect()}
        assert got == {1: [5, -1, -1, 7, -1] * 3, 2: [], 3: None, 4: [7]}


def test_large_vocabulary_writes_and_joins_rare_elements_only(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b a c a"), (2, "b a d"), (3, None), (4, "")], "doc_id long, text string")
    vocab = tk.build_vocabulary(df, "text")  # a 2, b 3, c 4, d 5
    monkeypatch.setattr(tk, "MAX_BROADCAST_ENTRIES", 4)
    written, checkpoint = [], tk.reliable_checkpoint
    monkeypatch.setattr(tk, "reliable_checkpoint", lambda x: written.append(checkpoint(x)) or written[-1])
    got = {r.doc_id: r.ids for r in tk.lookup_words(df, "doc_id", "text", vocab).collect()}
    assert got == {1: [2, 3, 2, 4, 2], 2: [3, 2, 5], 3: None, 4: []}
    rows = {r.doc_id: [w for v in r if isinstance(v, list) for w in v if isinstance(w, str)] for r in written[-1].collect()}
    assert rows == {1: ["c"], 2: ["d"], 3: [], 4: []}


def test_size_of_a_large_vocabulary_is_added_up_where_its_rows_lie(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b a c a"), (2, "b a d")], "doc_id long, text string")
    vocab = tk.build_vocabulary(df, "text").repartition(4)
    limited, limit = [], type(vocab).limit
    monkeypatch.setattr(type(vocab), "limit", lambda x, n: limited.append(x.columns) or limit(x, n))
    for entries in (4, 100):  # a part of it broadcast, all of it
        monkeypatch.setattr(tk, "MAX_BROADCAST_ENTRIES", entries)
        got = {r.doc_id: r.ids for r in tk.lookup_words(df, "doc_id", "text", vocab).collect()}
        assert got == {1: [2, 3, 2, 4, 2], 2: [3, 2, 5]}
    assert not [c for c in limited if "token" in c]  # rows that a limit lets through all go to one task
    size = tk._broadcast_size(vocab, "token", "token_id")
    assert (size.n, size.b) == (6, len(tk.WORD_EOS) + len(tk.WORD_UNK) + 4 + 6)
