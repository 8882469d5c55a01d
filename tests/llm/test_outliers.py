import random
import re
from collections import Counter

import numpy as np
import pytest

from slmeval.llm import outliers
from slmeval.llm.queries import QUERIES

RND = random.Random(9)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            len(lines) - len(set(lines)), len(covered))


def sentence(n, symbol=""):
    return " ".join("".join(RND.choice("abcdefghijklmnop") for _ in range(RND.randint(2, 9))) + symbol for _ in range(n))


def texts():
    block = sentence(9)
    return ["", None, " \n\t", "a", "one two " * 30, block + " x " + block + " y z " + block, sentence(7), sentence(8), "é" * 30 + "\n\n" + "é" * 30,
            "\n".join([block, block, "", " ", block, "\x85"]), "#*$%&|<> <<" * 5, "a b c d e f g h a b c d e f g h a", sentence(30000),
            "the " * 9, "x\x0by\x0cz\rw v"]


def test_statistics(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts() + texts()[:3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in outliers.text_statistics(df).collect()}
    assert got == {i: plain(t) for i, t, *_ in rows}


def plain_mcd(x):
    """Both starts and the concentration steps by numpy, with the module's constants."""
    floors = np.diag(np.array(outliers.FLOORS) ** 2)
    middle = np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
    mad = np.sort(np.abs(x - middle), axis=0)[(len(x) + 1) // 2 - 1]
    best = None
    for mean, cov in ((middle, np.diag((1.4826 * mad) ** 2) + floors), (x.mean(axis=0), np.cov(x.T, bias=True) + floors)):
        for _ in range(outliers.STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            core = x[d <= np.sort(d)[int(np.ceil(outliers.H * len(d))) - 1]]
            mean, cov = core.mean(axis=0), np.cov(core.T, bias=True) * outliers.consistency() + floors
        det = np.linalg.det(cov)
        if best is None or det < best[0]:
            best = det, mean, cov
    return best[1:]


def test_estimates_equal_numpy(spark):
    rng = np.random.RandomState(1)
    x = rng.multivariate_normal([1.6, 0.1, 0.05, 0.0], np.diag([0.01, 0.02, 0.01, 0.03]) + 0.004, 301)
    x[:60] += [0.5, 1.4, 0.0, 0.2]
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, x0 double, x1 double, x2 double, x3 double")
    r = outliers.group_estimates(df).first()
    mean, cov = plain_mcd(x)
    low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert r.n == 301 and np.allclose([r[m] for m in outliers.MEANS], mean) and np.allclose(low @ low.T, cov)


def test_consistency_factor():
    assert outliers.consistency(0.75, 4) == pytest.approx(1.486, abs=1e-3)


def test_outliers_go_and_clean_texts_stay(spark):
    rows, bad = [], set()
    for i in range(600):
        lang, source = RND.choice([("en", "a"), ("en", "b"), ("de", None), (None, "a")])
        junk = i % 9 == 0
        bad |= {i} if junk else set()
        rows.append((i, sentence(RND.randint(25, 90), RND.choice(["###", "%%%"]) if junk else ""), lang, source))
    rows += [(1000, "few words", "en", "a"), (1001, None, None, None), (1002, sentence(40), "xx", "rare"), (1003, "same words here " * 30, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for bound in (50_000, -1):  # by broadcast, and by key
        outliers.MAX_BROADCAST, old = bound, outliers.MAX_BROADCAST
        try:
            got = {r.id: (r.base_failed, r.kept) for r in outliers.judge_documents(df).collect()}
        finally:
            outliers.MAX_BROADCAST = old
        assert len(got) == len(rows)
        assert {i for i, (failed, kept) in got.items() if not kept and not failed} == bad
        assert {i for i, (failed, _) in got.items() if failed} == {1000, 1001, 1003} and got[1002] == (False, True)


def test_empty_and_ties(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert outliers.judge_documents(df).count() == 0
    same = spark.createDataFrame([(i, sentence.__name__ + " word" * 40 + f" {' '.join('abcdefgh')}", "en", "a") for i in range(50)],
                                 "doc_id long, text string, lang string, source string")
    assert same.count() == outliers.judge_documents(same).count()


def test_native_plan_and_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op10_robust_outliers"](spark, sf)
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, _, dup, repeat = plain(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and not (r.base_failed and r.kept)
        if quality.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept
    judged = [r for r in got if quality.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(not r.kept for r in judged) > 0.8 * len(judged)
