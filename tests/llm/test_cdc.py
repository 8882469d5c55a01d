import random

from slmeval.llm import cdc
from slmeval.llm.queries import QUERIES

RND = random.Random(3)
LONG = " ".join("".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 9))) for _ in range(3000))


def test_chunks_cover_and_are_bounded():
    import numpy as np

    for text in (LONG, "x" * 3000, "a", "é" * 100):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        ends = cdc.cut_points(raw)
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert ends[-1] == len(raw) and all(cdc.MIN <= n <= cdc.MAX for n in sizes[:-1]) and 0 < sizes[-1] <= cdc.MAX


def test_gear_hash_is_the_windowed_sum():
    import numpy as np

    raw = np.frombuffer(LONG[:200].encode(), dtype=np.uint8)
    slow, h = [], 0
    for b in raw.tolist():
        h = ((h << 1) + int(cdc.GEAR[b])) & 0xFFFFFFFF
        slow.append(h)
    assert cdc.gear_hashes(raw).tolist() == slow


def test_an_insertion_keeps_most_digests():
    a, b = cdc.chunks(LONG), cdc.chunks(LONG[:5000] + "inserted" + LONG[5000:])
    assert cdc.containment_of(a, b) > 0.95
    assert cdc.containment_of(a, cdc.chunks(LONG[::-1])) < 0.05


def test_strings_round_trip_and_empty():
    assert cdc.parse(cdc.to_string(cdc.chunks(LONG))) == cdc.chunks(LONG)
    assert cdc.to_string(cdc.chunks(None)) == cdc.to_string(cdc.chunks("")) == "."
    assert cdc.containment_of({}, {}) == 1.0 and cdc.containment_of({}, {1: 2}) == 0.0


def expected(rows):
    """rows (id, text) -> id -> text of the next in descending id order."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]


def same(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(map(tuple, cdc.with_next(df).collect()), key=key)
    return got == sorted(expected(rows), key=key)


def test_next_document(spark):
    rows = [(RND.randint(0, 10**9), f"t{i}") for i in range(300)]
    assert same(spark, rows)
    assert same(spark, [(1, "one")])
    assert same(spark, [(None, "x"), (2, None), (2, "a"), (2, "a"), (5, "z"), (None, "b")])
    assert same(spark, [(None, "x"), (None, "b")])
    assert same(spark, [(i, f"t{i}") for i in (10**18, 1, 2, 3, 4)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert cdc.likeness_to_edits(df).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    following = {i: (t, n) for i, t, n in expected(rows)}
    got = QUERIES["op2_chunk_fingerprints"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        text, nxt = following[r.doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        own = cdc.chunks(text)
        assert r.n_chars == len(text) and r.fingerprint == cdc.to_string(own)
        assert r.edited_fingerprint == cdc.to_string(cdc.chunks(edited))
        assert r.near_edited == cdc.containment_of(own, cdc.chunks(edited))
        assert r.near_next == cdc.containment_of(own, cdc.chunks(nxt))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, FINGERPRINT string")
    assert cdc.fingerprint_documents(df).columns == ["doc_id", "text", "fingerprint"]
