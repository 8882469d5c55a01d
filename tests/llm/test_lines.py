import random
import re

import numpy as np

from slmeval.llm import lines

RND = random.Random(8)
HAS = re.compile(r"[^\x20\x09-\x0D]")


def sentence(n):
    return " ".join("".join(RND.choice("abcdefghiklmnoprstu") for _ in range(RND.randint(2, 8))) for _ in range(n))


def edit(line):
    words = line.split(" ")
    words[RND.randrange(len(words))] = "changed"
    return " ".join(words)


def classes(docs, threshold=0.8):
    """Brute force over all pairs of distinct lines: (id, line_no) -> (first id, first line_no, kept)."""
    where = {}
    for d, t in docs:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if HAS.search(line):
                where.setdefault(line, []).append((d, k))
    distinct, parent = list(where), {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if lines.jaccard(a, b) >= threshold and find(a) != find(b):
                parent[find(a)] = find(b)
    groups = {}
    for line in distinct:
        groups.setdefault(find(line), []).extend(where[line])
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    return {p: (*min(g, key=key), p == min(g, key=key)) for g in groups.values() for p in g}


def documents():
    base = [sentence(RND.randint(12, 40)) for _ in range(40)]
    docs = []
    for i in range(60):
        own = [sentence(20) for _ in range(3)] + [RND.choice(base), edit(RND.choice(base)), edit(edit(RND.choice(base)))]
        RND.shuffle(own)
        docs.append((i, "\n".join([*own, "", "The.", " \t"])))
    return [*docs, (100, None), (101, ""), (102, "a"), (103, "a\na\nThe."), (None, base[0] + "\nlast"), (104, "\n\n"), (105, "x" * 9000)]


def test_equals_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.id, r.line_no): (r.first_id, r.first_line_no, r.kept) for r in lines.line_classes(df).collect()}
    expected = classes(docs)
    assert len(got) == len(expected)
    # candidates come from banding: at most a few links right at the threshold may be missed
    assert sum(got[k] != v for k, v in expected.items()) <= 0.002 * len(expected)


def test_hot_bands_are_salted_without_a_change(spark, monkeypatch):
    base = sentence(60)
    docs = [(i, edit(base) + "\n" + sentence(8)) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted(map(tuple, lines.line_classes(df).collect()))
    monkeypatch.setattr(lines, "HOT_SAMPLE", 1)
    monkeypatch.setattr(lines, "HOT_COUNT", 20)
    assert sorted(map(tuple, lines.line_classes(df).collect())) == plain
    assert {(r[0], r[2]): (r[3], r[4], r[5]) for r in plain} == classes(docs)


def test_large_bands_in_blocks(spark, monkeypatch):
    base = sentence(50)
    docs = [(i, edit(edit(edit(edit(base)))) + "\n" + sentence(8)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = classes(docs)
    assert 10 < len({v[:2] for k, v in expected.items() if k[1] == 0}) < 119  # several components in a band
    for block in (256, 7):
        monkeypatch.setattr(lines, "BLOCK", block)
        got = {(r.id, r.line_no): (r.first_id, r.first_line_no, r.kept) for r in lines.line_classes(df).collect()}
        assert got == expected


def test_overlap_matrix_equals_sets(monkeypatch):
    base = sentence(40)
    texts = ["a", "a b", base, base + " more", edit(base), edit(edit(edit(base))), sentence(40), base, "x" * 50]
    for columns in (4096, 3):
        monkeypatch.setattr(lines, "COLUMNS", columns)
        near = lines._overlaps(texts, 0.8)
        np.fill_diagonal(near, True)  # a line with itself is never asked for
        assert near.tolist() == [[lines.jaccard(a, b) >= 0.8 for b in texts] for a in texts]


def test_documents_keep_their_columns(spark):
    docs = [(2, "keep this line of text\nshared line of the text", 1, "k"), (1, "shared line of the text\n\n", 2, None),
            (3, "shared line of the text", 3, "k"), (4, None, 4, "k"), (5, "", 5, "k"), (3, "shared line of the text", 3, "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, keys string")
    out = lines.drop_duplicate_lines(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) == [
        (1, "shared line of the text\n\n", 2), (2, "keep this line of text", 22), (4, None, 4), (5, "", 5)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.line_classes(df).count() == 0 and lines.drop_duplicate_lines(df).count() == 0


def test_banding_recall():
    hits = total = 0
    for _ in range(400):
        a = sentence(RND.randint(6, 40))
        b = edit(a)
        if lines.jaccard(a, b) >= 0.8:
            x, y = lines.band_keys([a, b])
            total += 1
            hits += bool((x == y).any())
    assert total > 100 and hits >= 0.99 * total


def test_very_short_lines_are_exact():
    keys = lines.band_keys(["a", "b", "a"])
    assert (keys[0] == keys[2]).all() and not (keys[0] == keys[1]).any()


def test_removal_is_linear_in_the_lines_of_a_text(spark):
    import time

    text = "\n".join(["the same line again"] * 100_000 + [f"line number {i * 7919} of its own" for i in range(50)])
    df = spark.createDataFrame([(1, text), (2, "the same line again\nother words here")], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r.text.split("\n") for r in lines.drop_duplicate_lines(df).collect()}
    assert time.perf_counter() - start < 60
    assert got[1][0] == "the same line again" and got[1].count("the same line again") == 1 and got[2] == ["other words here"]


def test_pairs_in_bulk_equal_pairs_one_by_one():
    rnd = random.Random(12)
    texts = ["".join(rnd.choices("abc ", k=rnd.randint(1, 30))) for _ in range(60)]
    left, right = [rnd.choice(texts) for _ in range(400)], [rnd.choice(texts) for _ in range(400)]
    assert lines.jaccards(left, right).tolist() == [lines.jaccard(x, y) for x, y in zip(left, right)]
