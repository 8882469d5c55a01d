import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from slmeval.llm import collocations as co
from slmeval.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_count, max_words=4, covered=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, p), a in found.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        longer = [d for (l2, q), d in found.items() if l2 == lang and len(q) > len(p)
                  and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * d >= covered * a for d in longer):
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    rows = []
    for lang, best in out.items():
        for i, (score, a, p, left, right) in enumerate(sorted(best)[:top]):
            rows.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def got(df, **how):
    found = co.collocations(df, **how).drop("words").collect()
    return sorted(tuple(r) for r in found)


def texts(rnd, n, words):
    out = []
    for _ in range(n):
        body = []
        for _ in range(rnd.randint(0, 60)):
            body.append(rnd.choice(words) if rnd.random() < 0.7 else rnd.choice(["new york city hall", "De la  Vega", "a a a a a"]))
            body.append(rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]))
        out.append("".join(body))
    return out


@pytest.mark.parametrize("seed,parts,top", [(1, 1, 2000), (2, 7, 2000), (3, 23, 5)])
def test_equals_brute_force(spark, seed, parts, top):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "é", "Éa", "x-y", " z", "ß", "end", "q"]
    rows = [(rnd.choice(["en", "en", "en", "fr", None, "und"]), t) for t in texts(rnd, 60, words)]
    rows += [("en", None), (None, ""), ("de", "only one."), ("en", " \t.,;")]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "lang string, text string, f long, Words string")
    for min_count, max_words, covered in ((3, 4, 80), (2, 2, 50), (4, 3, 100)):
        expected = plain(rows, min_count, max_words, covered, top)
        assert got(df, min_count=min_count, max_words=max_words, covered=covered, top=top, num_partitions=parts) == expected
    assert plain(rows, 3, top=top)


def test_bitmaps_only_skip_work(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [("en", t) for t in texts(rnd, 30, [f"w{i}" for i in range(40)])]
    df = spark.createDataFrame(rows, "lang string, text string")
    expected = plain(rows, 2)
    assert got(df, min_count=2) == expected
    monkeypatch.setattr(co, "MIN_BITS", 6)
    monkeypatch.setattr(co, "MAX_BITS", 6)  # nearly full: nothing is skipped, nothing changes
    assert got(df, min_count=2) == expected


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(co, "SLICE_BYTES", 40)
    rnd = random.Random(4)
    text = " ".join(texts(rnd, 10, ["alpha", "Beta"])) + " " + "long piece without an end " * 10
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "b"])], names=["lang", "text"])
    f = Counter()
    for _, s in co._slices(iter([batch])):
        words = s.words.to_pylist()
        for i in range(len(s.codes)):
            f[words[s.codes[i]],] += 1
            if s.joined[i]:
                f[words[s.codes[i]], words[s.codes[i + 1]]] += 1
    expected = Counter()
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)) + ["b"]:
        words = piece.split()
        expected.update((w,) for w in words)
        expected.update(zip(words, words[1:]))
    assert f == expected


def test_products_beyond_64_bits():
    huge = 1 << 61
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"]), pa.array([["a", "b"]]), pa.array([huge]), pa.array([[huge + 1]]), pa.array([[huge + 2]])],
        names=["lang", "words", "f", "left", "right"])
    (out,) = co._score(iter([batch]))
    assert out.column(5).to_pylist() == [2_000_000 * huge // (2 * huge + 3)]


def test_hot_word_and_repeated_rows(spark):
    rows = [("en", "hot " * 3000 + "tail")] + [("en", "hot hot iron. cold steel")] * 200 + [("fr", "hot hot")] * 2
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(df, min_count=30, num_partitions=3) == plain(rows, 30)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert got(df) == []
    assert got(spark.createDataFrame([(None, None)], df.schema)) == []
    with pytest.raises(ValueError):
        co.collocations(df, max_words=1)


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    expected = sorted(con.execute(ORACLE_SQL["op12_collocations"]).fetchall())
    found = QUERIES["op12_collocations"](spark, SF)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == expected and expected
