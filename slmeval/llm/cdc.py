"""Document fingerprints by content-defined chunking.

The UTF-8 bytes of a text are cut where a gear hash of the last 32 bytes has zero top bits. The
chunk lengths are normalised: within a chunk no cut falls before ``MIN`` bytes, up to ``NORMAL``
bytes a strict mask applies, from there a loose one, and at ``MAX`` bytes a cut is made. Cuts
depend on nearby bytes only, so an insertion moves the chunks behind it and they keep their
digests. A fingerprint is the set of chunk digests (XXH64), each weighted by its length; the
containment of A in B is the share of A's weight whose digests B has.

``fingerprint``: lowercase hex, 16 digits for each distinct digest in ascending order, a dot, and
4 digits for each one's length. Equal texts have equal fingerprints; an empty or null text has the
fingerprint ``.``. Containment of an empty fingerprint is 1 in an empty one and 0 in any other.

``with_next`` pairs each document with its successor by id without a global window: the table
is dealt into id ranges whose bounds are ids of the table (approximate quantiles, one number for
each partition), and a range borrows the first document of the one behind it.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, partitions, put

MIN, NORMAL, MAX = 32, 64, 256  # MIN covers the gear hash's window, so a chunk decides alone
STRICT_BITS, LOOSE_BITS = 7, 5
SLICE_BYTES = 1_000_000
LIKENESS = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
GEAR = np.array([random.Random(f"gear {i}").getrandbits(32) for i in range(256)], dtype=np.uint32)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum of ``GEAR[byte] << age`` over the last 32 bytes."""
    h = GEAR[raw]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    return h


def cut_points(raw: np.ndarray) -> list[int]:
    """End offsets of the chunks of one text."""
    n = len(raw)
    h = gear_hashes(raw)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT_BITS) == 0].tolist()
    loose = loose.tolist()
    strict.append(n)
    loose.append(n)
    ends, start = [], 0
    while n - start > MIN:
        p = strict[bisect_left(strict, start + MIN - 1)]
        if p >= start + NORMAL:
            p = min(loose[bisect_left(loose, start + NORMAL - 1)], start + MAX - 1)
        start = min(p + 1, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(text: str | None) -> dict[int, int]:
    """Digest -> length of each distinct chunk."""
    data = text.encode() if text else b""
    if not data:
        return {}
    raw, out, start, view, digest = np.frombuffer(data, dtype=np.uint8), {}, 0, memoryview(data), xxhash.xxh64_intdigest
    for end in cut_points(raw):
        out[digest(view[start:end])] = end - start
        start = end
    return out


def to_string(parts: dict[int, int]) -> str:
    digests = np.sort(np.fromiter(parts, dtype=np.uint64, count=len(parts)))
    lengths = np.array([parts[d] for d in digests.tolist()], dtype=">u2")
    return f"{digests.astype('>u8').tobytes().hex()}.{lengths.tobytes().hex()}"


def parse(fingerprint: str) -> dict[int, int]:
    digests, lengths = (bytes.fromhex(x) for x in fingerprint.split("."))
    return dict(zip(np.frombuffer(digests, dtype=">u8").tolist(), np.frombuffer(lengths, dtype=">u2").tolist()))


def containment_of(a: dict[int, int], b: dict[int, int]) -> float:
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text column."""

    @F.arrow_udf("string")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([to_string(chunks(x.as_py())) for x in batch], type=pa.string())

    return prints(text)


def containment(a: Column, b: Column) -> Column:
    """Weighted containment of fingerprint ``a`` in fingerprint ``b`` (null if either is null)."""

    @F.arrow_udf("double")
    def contained(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([None if x is None or y is None else containment_of(parse(x), parse(y))
                            for x, y in zip(left.to_pylist(), right.to_pylist())], type=pa.float64())

    return contained(a, b)


def _range_number(id: Column, cuts: list[int]) -> Column:
    """Number of ``cuts`` (descending) at or above the id: a two-level search, so a row is compared
    with about twice the square root of the cuts. Null ids come after all others."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    fine = F.array(*[F.lit(c) for c in cuts])
    coarse = F.array(*[F.lit(c) for c in cuts[step - 1 :: step]])
    block = F.size(F.filter(coarse, lambda c: c >= id)) * step
    rest = F.size(F.filter(F.slice(fine, block + 1, F.lit(step)), lambda c: c >= id))
    return F.when(id.isNull(), F.lit(len(cuts))).otherwise(block + rest)


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Sorted rows (range, id, text, borrowed), a range's own before the borrowed ones -> ids, texts and
    next texts of the own rows, in slices."""
    held = None  # the last row, whose successor may be in the next slice
    for whole in batches:
        for a, b in arrow_slices(whole.column(2), SLICE_BYTES):
            batch = whole.slice(a, b - a)
            batch = pa.concat_batches([held, batch]) if held is not None else batch
            ranges, borrowed = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            own = np.flatnonzero(~borrowed[:-1] & (ranges[:-1] == ranges[1:]))
            at, after = pa.array(own), pa.array(own + 1)
            if len(own):
                yield batch.column(1).take(at), batch.column(2).take(at), batch.column(2).take(after)
            held = pa.concat_batches([batch.slice(batch.num_rows - 1)])  # a copy: the slice goes


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns in _pair_up(batches):
        yield pa.RecordBatch.from_arrays(list(columns), names=["id", "text", "next_text"])


def edited(text: str, following: str) -> str:
    """The text with its last half of code points (rounded down) replaced by the first as many, or
    all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, following in _pair_up(batches):
        rows = []
        for x, y in zip(texts.to_pylist(), following.to_pylist()):
            changed = edited(x, y)
            own, of_edited = chunks(x), chunks(changed)
            rows.append((len(x), changed, to_string(own), to_string(of_edited), containment_of(own, of_edited),
                         containment_of(own, chunks(y))))
        columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), (
            pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([ids, *columns], names=LIKENESS)


def _in_ranges(df: DataFrame, id: str, text: str) -> DataFrame:
    """(range, id, text, borrowed), dealt by range and sorted: descending ids, then the borrowed rows."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions(df.sparkSession)
    found = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cuts"),
                     F.max("id").alias("top")).first()
    cuts = sorted(set(found.cuts or []), reverse=True)
    number = _range_number(F.col("id"), cuts)
    # A cut is the first id of its range; that range lends it to the one before, the first to the last.
    if cuts:
        lent = F.when(F.col("id").isin(cuts) & (F.col("id") == found.top), F.array(number - 1, F.lit(len(cuts)))) \
            .when(F.col("id") == found.top, F.array(F.lit(len(cuts)))) \
            .when(F.col("id").isin(cuts), F.array(number - 1)).otherwise(F.array().cast("array<int>"))
    else:
        first = F.col("id") == found.top if found.top is not None else F.lit(True)
        lent = F.when(first, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    copies = F.concat(F.array(F.struct(number.alias("range"), F.lit(False).alias("borrowed"))),
                      F.transform(lent, lambda r: F.struct(r.alias("range"), F.lit(True).alias("borrowed"))))
    dealt = rows.select("id", "text", F.explode(copies).alias("to")).select("to.range", "id", "text", "to.borrowed")
    return dealt.repartitionByRange(n, "range").sortWithinPartitions(
        "range", "borrowed", F.col("id").desc_nulls_last(), "text")


def with_next(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, next_text): each row with the text of the next one in descending id order, the last
    with that of the first (a single row with its own). Null texts are empty. Rows with equal ids
    follow each other in the order of their texts, null ids come last."""
    out = _in_ranges(df, id, text).mapInArrow(_pairs, "id bigint, text string, next_text string")
    return out.withColumnRenamed("id", id).withColumnRenamed("text", text)


def fingerprint_documents(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Append the fingerprint of every whole text (a column of that name is replaced)."""


    return put(df, **{out: fingerprint(F.col(text))})


def likeness_to_edits(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next): each document's
    fingerprint and that of its edited text, with the containment of the first in the second and in its
    successor's. One Python pass over the rows as ``with_next`` pairs them."""
    types = ["bigint", "bigint", "string", "string", "string", "double", "double"]
    schema = ", ".join(f"{n} {t}" for n, t in zip(LIKENESS, types))
    return _in_ranges(df, id, text).mapInArrow(_likeness, schema).withColumnRenamed("id", id)
