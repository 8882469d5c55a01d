"""Every stage against its operator's brute force on its own input, and the registration."""

import hashlib

import pytest

import corpus_pipeline
from slmeval.llm import langid, mixing, queries

from test_lines import classes
from test_simhash import components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows, input columns, output columns) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def test_columns(stages):
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mix_sources", "encode"]
    for name, (_, _, before, after) in stages.items():
        assert after == before or name == "encode"


def test_language_id(spark, stages):
    before, after, *_ = stages["language_id"]
    classify = langid.Classifier(queries.language_dictionaries(spark.read.parquet(f"{SF}/documents.parquet")))
    accepted = {r.doc_id for r in before if (f := classify(r.text))[0] != "und" and f[1] >= langid.MIN_MARGIN}
    assert {r.doc_id for r in after} == accepted and len(accepted) > 0.97 * len(before)


def test_line_dedup(stages):
    before, after, *_ = stages["line_dedup"]
    verdict = classes([(r.doc_id, r.text) for r in before])
    expected = {}
    for r in before:
        lines = r.text.split("\n")
        kept = [x for k, x in enumerate(lines) if (r.doc_id, k) not in verdict or verdict[r.doc_id, k][2]]
        if kept == lines or any((r.doc_id, k) in verdict and verdict[r.doc_id, k][2] for k in range(len(lines))):
            expected[r.doc_id] = "\n".join(kept)
    assert {r.doc_id: r.text for r in after} == expected
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_dedup(stages):
    before, after, *_ = stages["near_dedup"]
    rows = sorted((r.doc_id, r.text) for r in before)
    groups = components([plain_fingerprint(t) for _, t in rows], 4)
    assert sorted(r.doc_id for r in after) == sorted({rows[g][0] for g in groups})


def test_mix_sources(spark, stages):
    before, after, columns, _ = stages["mix_sources"]
    shares = mixing.mix(spark.createDataFrame(before)).collect()
    often = {r.id: int(r.taken / r.size + 0.5) if r.size else 1 for r in shares}
    assert sorted(r.doc_id for r in after) == sorted(d for d, n in often.items() for _ in range(n))
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_encode(stages):
    import tiktoken

    before, after, *_ = stages["encode"]
    ranks, pattern = queries.bpe_files()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_and_registration(spark, stages):
    import __spark_entry__ as entry

    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in stages["encode"][1])
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


def test_stages_on_awkward_documents(spark):
    rows = [(1, None, "en", None, 0, "x"), (2, "", None, "a", 0, "x"), (3, "the text of a document that stays", "en", "a", 33, "x"),
            (3, "the text of a document that stays", "en", "a", 33, "x"), (None, "word " * 20000, "de", "b", 100000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == df.columns and out.count() <= 3 * len(rows)
            if docs is df:  # no stage drops the plain document, or all copies of it
                assert "the text of a document that stays" in {r.text for r in out.collect()}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
