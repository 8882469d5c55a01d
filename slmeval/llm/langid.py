"""Language identification by compression with per-language zstandard dictionaries.

Learning: each label gets a raw-content dictionary of at most ``dict_bytes`` bytes, made of
excerpts of at most ``excerpt_chars`` characters of at most ``slots`` of its texts (the bounds
of the training sample). A text's XXH64 picks its slot and its order, so the sample does not
depend on the row order or the file layout, and equal texts count once. The sample is found
with a grouped minimum over (label, slot); only those texts are gathered.

Texts are lower-cased and every run of other characters than letters is one space.
Prediction: the text is cut into blocks of ``block_chars`` characters, every block of
the whole text is compressed with each dictionary, and the label with the smallest total wins
(ties: the first label by name). The score is the margin ``1 - smallest / second smallest``; a
margin below ``min_margin`` is a rejection (``accepted`` false), also of texts without a letter.

Results: a null text or one without a letter is ``und`` with score 0. With one learned label the
score is 1; with none every text is ``und``. Repeated rows are judged each by itself; extra
columns are kept and columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, put, reliable_checkpoint

SLOTS = 160
EXCERPT_CHARS = 1500
DICT_BYTES = 112_000
BLOCK_CHARS = 1500
MIN_MARGIN = 0.002
LEVEL = 5  # below 5 zstd's faster parsers find few of the short matches that tell languages apart
MAX_LABELS = 500  # dictionaries are broadcast: at most max_labels * dict_bytes bytes

LETTER = regex.compile(r"\p{L}")  # learning and prediction agree on what a letter is: Unicode category L
NO_LETTERS = regex.compile(r"\P{L}+")


def normalise(text: str) -> str:
    return NO_LETTERS.sub(" ", text.lower())


def learn(df: DataFrame, text: str = "text", label: str = "lang", slots: int = SLOTS,
          excerpt_chars: int = EXCERPT_CHARS, dict_bytes: int = DICT_BYTES, max_labels: int = MAX_LABELS) -> dict[str, bytes]:
    """Label -> raw dictionary content, from the rows with a label and a text. More than ``max_labels`` labels
    are an error, as the dictionaries are broadcast."""
    rows = df.select(F.col(label).alias("label"), F.col(text).alias("text")).filter(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    slot = F.pmod(F.col("h"), F.lit(slots))
    picked = reliable_checkpoint(hashed.groupBy("label", slot.alias("slot")).agg(F.min("h").alias("h")).select("label", "h"))
    labels = picked.select("label").distinct().limit(max_labels + 1).count()
    if labels > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    sample = hashed.join(F.broadcast(picked), ["label", "h"]).select(
        "label", "h", F.substring("text", 1, excerpt_chars).alias("text"))
    sample = sample.groupBy("label", "h").agg(F.min("text").alias("text"))
    out: dict[str, bytes] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.label, r.h)):
        out[r.label] = (out.get(r.label, b"") + normalise(r.text).encode() + b"\n")[:dict_bytes]
    return dict(sorted(out.items()))


class Classifier:
    def __init__(self, contents: dict[str, bytes], block_chars: int = BLOCK_CHARS):
        self.labels, self.block, self.compress = list(contents), block_chars, []
        for content in contents.values():
            # zstandard needs 8 bytes of dictionary
            d = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.labels or not LETTER.search(text):
            return "und", 0.0
        text, sizes = normalise(text), np.zeros(len(self.labels), dtype=np.int64)
        for i in range(0, len(text), self.block):
            block = text[i : i + self.block].encode()
            sizes += [len(f(block)) for f in self.compress]
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.labels[0], 1.0
        second = int(np.delete(sizes, best).min())
        return self.labels[best], 1.0 - sizes[best] / second


def predict_column(spark: SparkSession, text: Column, contents: dict[str, bytes]) -> Column:
    """STRUCT<lang, score> of a text column."""
    shared = spark.sparkContext.broadcast(contents)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classify = Classifier(shared.value)
        for batch in batches:
            found = [classify(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())],
                names=["lang", "score"])

    return predict(text)


def identify(df: DataFrame, contents: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN,
             lang: str = "lang_pred", score: str = "score", accepted: str = "accepted") -> DataFrame:
    """Append the predicted label, its score and whether the margin is wide enough."""
    (p,) = fresh_names(df, "prediction")
    found = df.withColumn(p, predict_column(df.sparkSession, F.col(text), contents))
    out = put(found, **{lang: F.col(f"{p}.lang"), score: F.col(f"{p}.score"),
                        accepted: (F.col(f"{p}.lang") != "und") & (F.col(f"{p}.score") >= min_margin)})
    return out.drop(p)
