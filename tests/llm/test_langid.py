from slmeval.llm import langid, queries

WORDS = {"de": "der die das und nicht einheit geheit schlich über", "en": "the and with that thing ention over", "fr": "le la les été nous être oiseau"}


def table(spark):
    rows = [(lang, " ".join(w.split()[(i * k) % len(w.split())] for k in range(30))) for i in range(1, 40) for lang, w in WORDS.items()]
    return spark.createDataFrame([*rows, (None, "the the"), ("en", None), ("en", "123")], "lang string, text string")


def test_learn_and_predict(spark):
    contents = langid.learn(table(spark))
    assert list(contents) == ["de", "en", "fr"] and all(len(c) <= langid.DICT_BYTES for c in contents.values())
    df = spark.createDataFrame([("der und die geheit nicht das", 1), ("the that and with thing", 2), (None, 3), ("", 4), ("12 !?", 5),
                                ("été nous les oiseau " * 5000, 6)], "text string, Score int")
    out = langid.identify(df, contents)
    assert out.columns == ["text", "lang_pred", "score", "accepted"]
    got = [(r.lang_pred, r.accepted) for r in out.collect()]
    assert got == [("de", True), ("en", True), ("und", False), ("und", False), ("und", False), ("fr", True)]
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_sample_does_not_depend_on_order_or_copies(spark):
    df = table(spark)
    assert langid.learn(df) == langid.learn(df.union(df).repartition(5))


def test_one_and_no_label(spark):
    one = langid.Classifier({"en": b"the and"})
    assert one("anything") == ("en", 1.0)
    empty = spark.createDataFrame([], "lang string, text string")
    assert langid.learn(empty) == {}
    assert langid.Classifier({})("text") == ("und", 0.0)
    assert langid.identify(empty, {}).count() == 0


def test_ties_take_the_first_label():
    same = langid.Classifier({"a": b"same words here", "b": b"same words here"})
    assert same("same words here") == ("a", 0.0)


def test_label_bound(spark):
    import pytest

    with pytest.raises(ValueError, match="labels"):
        langid.learn(table(spark), max_labels=2)


def test_numbers_are_no_letters(spark):
    contents = langid.learn(table(spark))
    classify = langid.Classifier(contents)
    for text in ("½", "² ³", "Ⅷ", "①", "١٢", "_", "\u0301", "😀"):
        assert classify(text) == ("und", 0.0), text
    assert all(classify(t)[0] != "und" for t in ("ª", "ʰ", "語", "x½"))
    assert langid.normalise("A½b Ⅷ_2é") == "a b é"
    numbers = spark.createDataFrame([("xx", "½ Ⅷ ²")], "lang string, text string")
    assert langid.learn(numbers) == {}


def plain_sample(rows):
    """Of each label and slot the text with the smallest hash; dictionaries in hash order."""
    import xxhash

    picked = {}
    for lang, text in rows:
        if lang is None or text is None or not any(map(str.isalpha, text)):
            continue
        h = xxhash.xxh64_intdigest(text.encode(), seed=42)
        h -= (h >> 63) << 64
        key = (lang, h % langid.SLOTS)
        if key not in picked or h < picked[key][0]:
            picked[key] = (h, text)
    out = {}
    for lang, h, text in sorted((k[0], h, t) for k, (h, t) in picked.items()):
        words = "".join(c if c.isalpha() else " " for c in text[: langid.EXCERPT_CHARS].lower()).split(" ")
        clean = " ".join(w for i, w in enumerate(words) if w or i in (0, len(words) - 1))
        out[lang] = (out.get(lang, b"") + clean.encode() + b"\n")[: langid.DICT_BYTES]
    return out


def plain_prediction(text, dictionaries):
    import zstandard

    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
    clean = " ".join(w for i, w in enumerate(words) if w or i in (0, len(words) - 1))
    sizes = {}
    for lang, content in dictionaries.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[lang] = sum(len(c.compress(clean[i : i + langid.BLOCK_CHARS].encode())) for i in range(0, len(clean), langid.BLOCK_CHARS))
    first, second = sorted(sizes, key=lambda k: (sizes[k], k))[:2]
    return first, 1 - sizes[first] / sizes[second]


def test_query_by_brute_force(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    dictionaries = plain_sample([(r.lang, r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5])
    expected = {r.doc_id: plain_prediction(r.text, dictionaries) for r in rows}
    got = queries.QUERIES["op6_compression_langid"](spark, sf).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in got} == expected


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in queries.QUERIES["op6_compression_langid"](spark, sf).collect()]
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.95 * len(held)
    assert sum(r.accepted for r in got) > 0.98 * len(got)
