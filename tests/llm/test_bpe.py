import hashlib

import numpy as np
import pytest

from slmeval.llm import bpe, queries

TEXTS = ["", "a", "hello's world  \n\n foo\x1c\x1dbar \u2003x\u3000y ", " ", "   ", "\n", "a  b\t\tc", "x" * 5000,
         "I'm you'll 123 ½ ²x Ⅷ 漢字 🙂🙂 " + "ab" * 300 + " zz" + "!" * 400 + " " * 300, "'s's 't\u0085 \u200b\ufeff", "éèế ḋ"]


@pytest.fixture(scope="module")
def files():
    return queries.bpe_files()


@pytest.fixture(scope="module")
def library(files):
    import tiktoken

    ranks, pattern = files
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split(ids, counts):
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def test_ids_equal_the_library(files, library):
    encoder = bpe.Encoder(*files)
    for _ in range(2):  # the second time from the cache
        assert split(*encoder.encode(TEXTS)) == [library.encode_ordinary(t) for t in TEXTS]


def test_long_match_equals_matrix(files):
    encoder = bpe.Encoder(*files)
    piece = b"therethenother" * 12
    flat, starts, lengths = encoder.pieces([piece])
    assert encoder._long(piece).tolist() == flat[starts[0]:starts[0] + lengths[0]].tolist()


def test_round_trip_nulls_and_clashing_names(spark, files):
    ranks, pattern = files
    rows = [(i, t, 7) for i, t in enumerate([*TEXTS, None, TEXTS[2]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    out = bpe.decode_documents(bpe.encode_documents(df, ranks, pattern), ranks)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    both = bpe.encode_documents(df, ranks, pattern, decoded="decoded", keep=["doc_id"])
    assert both.columns == ["doc_id", "ids", "decoded"]
    assert {r.doc_id: (r.ids, bytes(r.decoded)) for r in both.collect()} == {r.doc_id: (r.ids, bytes(r.decoded)) for r in out.collect()}
    null = out.filter("text is null").first()
    assert null.ids == [] and bytes(null.decoded) == b""


def test_unknown_id_raises_and_null_ids(spark, files):
    ranks, _ = files
    df = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode_documents(df, ranks).collect()] == [b"", b""]
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode_documents(spark.createDataFrame([([10**6],)], "ids array<int>"), ranks).collect()


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op1_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark, files):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert queries.encoded(df, ["doc_id"]).count() == 0


def test_rank_bound(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_RANKS", 1)
    with pytest.raises(ValueError, match="ranks"):
        bpe.parse_ranks([b"YQ== 0", b"Yg== 1"])
