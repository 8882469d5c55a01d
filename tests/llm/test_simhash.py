import random
import re

import numpy as np
import pytest
import xxhash

from slmeval.llm import simhash
from slmeval.llm.components import connected_components
from slmeval.llm.queries import QUERIES

RND = random.Random(6)


def plain_fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, bits):
    """Brute force: value -> smallest index reachable."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for text in ("", None, "A", "One two THREE", "a b c d", "É é x\x85y " * 30, "same " * 50, "w " * 70000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("size,shared", [(s, m) for m in range(1, 9) for s in range(1, m + 1)])
def test_position_sets_cover(size, shared):
    from itertools import combinations

    sets = [set(s) for s in simhash.position_sets(size, shared)]
    assert all(len(s) == size for s in sets)
    assert all(any(s <= set(c) for s in sets) for c in combinations(range(8), shared))


def flip(value, n):
    for b in RND.sample(range(64), n):
        value ^= 1 << b
    return value


def values():
    out = [RND.getrandbits(64) for _ in range(300)]
    for center in list(out[:6]):  # near groups whose members are not all near one another, and chains
        out += [flip(center, RND.randint(1, 6)) for _ in range(60)]
    v = out[7]
    for _ in range(30):
        v = flip(v, 4)
        out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("block,set_size,bits", [(2048, 2, 4), (2048, 3, 4), (16, 2, 4), (16, 4, 4), (9, 2, 6), (2048, None, 0)])
def test_links_equal_brute_force(spark, block, set_size, bits):
    fps = values()
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = dict(map(tuple, simhash.near_links(df, bits, block, set_size).collect()))
    own = [got.get(v, v) for v in signed]
    expected = components(fps, bits)
    assert len(set(zip(own, expected))) == len(set(own)) == len(set(expected))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 5), (9, 8), (8, 9), (None, 4), (4, None)] + [(i, i + 1) for i in range(100, 160)] + [(200, 300 + i) for i in range(50)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 200: 200} | {i: 100 for i in range(100, 161)} | {300 + i: 200 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXT = " ".join(f"w{RND.randint(0, 500)}" for _ in range(400))
DOCS = [(5, TEXT), (3, TEXT), (9, TEXT.replace(" w", "  W", 3)), (1, None), (2, ""), (7, "alone"), (None, TEXT), (None, "null id only"),
        (None, "null id only"), (4, "tie"), (4, "tie"), (4, "another text of the same id"), (11, "x " * 20000)]


def test_documents(spark):
    df = spark.createDataFrame([(*d, 1, "k") for d in DOCS], "doc_id long, text string, component_id int, Fingerprint string")
    got = {(r.id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df).collect()}
    unsigned = lambda t: np.array([plain_fingerprint(t)], dtype=np.uint64).view(np.int64)[0]
    assert len(simhash.near_duplicates(df).collect()) == len(DOCS)
    assert got[5, unsigned(TEXT)] == got[3, unsigned(TEXT)] == got[None, unsigned(TEXT)] == 3
    assert got[1, 0] == got[2, 0] == 1 and got[None, unsigned("null id only")] is None
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, TEXT), (1, None), (7, "alone"), (None, "null id only"), (4, "tie"), (4, "another text of the same id"), (11, "x " * 20000)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    expected = {d: (f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, components(fps, 4))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, sf).collect()} == expected
