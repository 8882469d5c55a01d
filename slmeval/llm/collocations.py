"""Phrase collocations by external count streams in prefix and suffix order.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces into words at
spaces and tabs. f(phrase) counts its contiguous occurrences inside pieces, per language. Candidates are
phrases of 2 to ``max_words`` words that occur at least ``min_count`` times. Cutting one after k words
gives l = f(first part), r = f(rest) and the score floor(``SCALE`` * a / (l + r)); the lowest cut counts.
A candidate goes if a longer one that holds it has at least ``covered`` percent of its count.

1. Count streams, shortest phrases first. Every slice of text is counted by sorting codes of its words
   (numpy); words are added up by a grouped sum. The longer phrases of a slice are dealt by hash to
   bins, sorted, and packed, a compressed block for each bin; one task adds up the blocks of a bin. There is
   a bin for ``BIN_WORDS`` words of text, so a bin does not grow with the corpus, and a hot phrase is one
   row of a slice. Only phrases with ``min_count`` occurrences are kept: no other can be part of a
   candidate. So a pass over longer phrases skips places whose shorter parts are too rare, which it
   sees in a bitmap of the hashes of those that are kept. The bitmap has at most 2^``MAX_BITS`` bits at
   any size of the corpus and only ever lets too much through; counts come from the words themselves.
2. Prefix order: the streams of all lengths, range-partitioned and sorted by (language, words), so a
   phrase comes after its first parts. One lockstep walk holds the counts of the current phrase's
   first parts (at most ``max_words``) and gives every l without a lookup; a partition starts with
   the counts of the first parts of its first phrase, three numbers for each partition.
3. Suffix order: the same walk over reversed words gives every r, and the scores.
4. Extension counts: in either order a phrase meets the phrase it extends by one word, and marks it if
   it has ``covered`` percent of its count. A longer candidate that covers a phrase also makes one of
   those in between cover it, so one word more is enough. Marked phrases go by an anti join.

Scale: a stream has at most one row for ``min_count`` words of text; hot words are spread by the
range partitions, and the walks hold a few numbers. Scores are computed with whole numbers of any length
in Python. The best ``top`` of a language are found by partial top-k before the exchange.

Results: null texts are empty, a null language is ``und``. Repeated rows count each. Ties follow the phrase in
byte order. Texts longer than a slice are cut between pieces; a piece is never cut. Extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import PID, range_checkpoint
from .common import partitions, reliable_checkpoint

MIN_COUNT = 30
MAX_WORDS = 4
COVERED = 80
TOP = 2000
SCALE = 2_000_000
SLICE_BYTES = 4_000_000
BIN_WORDS = 4_000_000
MIN_BITS, MAX_BITS = 16, 26  # powers of two; 2^26 bits are 8 MB
BITS_EACH = 16

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow text column without nulls."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """64-bit hashes of (language, word); only the bitmaps use them. No word is empty."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    offsets, data = _buffers(words)
    sizes, first = np.diff(offsets), offsets[:-1] - offsets[0]
    data = data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    powers = np.full(int(sizes.max()), _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(data)) - np.repeat(first, sizes)
    h = np.add.reduceat(data * powers[place], first)
    salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    return _scramble(_scramble(h + sizes.astype(np.uint64)) ^ salt)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _scramble(a * np.uint64(3) + _scramble(b + _BASE))


class Bitmap:
    def __init__(self, bits: int, cells: np.ndarray | None = None):
        self.bits, self.cells = bits, cells

    def place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.place(h)
        return (self.cells[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Slice:
    """The words of some texts of one language: ``codes`` into ``words``, and whether the next word is in
    the same piece."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, dtype=np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(start) + 1, dtype=np.int32)
        np.cumsum(end - start, out=offsets[1:])
        letters = _LOWER[raw[inside]]
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        self.words, self.codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.rank = np.empty(len(self.words), dtype=np.int64)  # of each word in byte order
        self.rank[pc.sort_indices(self.words).to_numpy()] = np.arange(len(self.words))
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        self.joined = np.append(piece[1:] == piece[:-1], False)[: len(start)]

    def take(self, codes: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(codes))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Slice]]:
    """(language, words) of the texts of (lang, text) batches, about ``SLICE_BYTES`` each; a longer text
    is cut between pieces."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            by_lang.setdefault(lang, []).append(memoryview(text.as_buffer()))
        for lang, texts in by_lang.items():
            held, size = [], 0
            for text in texts:
                for part in _parts(text):
                    if size and size + len(part) > SLICE_BYTES:
                        yield lang, Slice(b"\n".join(held))
                        held, size = [], 0
                    held.append(part)
                    size += len(part)
            yield lang, Slice(b"\n".join(held))


def _parts(text: memoryview) -> Iterator[memoryview]:
    if len(text) <= SLICE_BYTES:
        yield text
        return
    ends, start = np.flatnonzero(_KIND[np.frombuffer(text, dtype=np.uint8)] == 2), 0
    while start < len(text):
        k = int(np.searchsorted(ends, start + SLICE_BYTES))
        end = int(ends[k]) + 1 if k < len(ends) else len(text)
        yield text[start:end]
        start = end


def _rows(lang: str, columns: list[pa.Array], count: np.ndarray) -> pa.RecordBatch:
    n = len(count)
    return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(n, dtype=np.int8))), *columns, pa.array(count.astype(np.int64))],
                                      names=["lang", *[f"w{i + 1}" for i in range(len(columns))], "f"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f), and a row without a word for the number of words."""
    for lang, s in _slices(batches):
        if len(s.codes):
            yield _rows(lang, [s.words], np.bincount(s.codes, minlength=len(s.words)))
            yield _rows(lang, [pa.array([None], type=pa.string())], np.array([len(s.codes)]))


def _packed(lang: str, s: Slice, codes: np.ndarray, f: np.ndarray, h: np.ndarray, bins: int) -> pa.RecordBatch:
    """(lang, bin, phrases, counts): the phrases (rows of ``codes``) of each bin in word order, compressed."""
    bin_of = (h % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((*s.rank[codes].T[::-1], bin_of))
    codes, f, bin_of = codes[order], f[order], bin_of[order]
    bin_ids, start = np.unique(bin_of, return_index=True)
    ends = np.append(start, len(f)).astype(np.int32)
    phrases = pc.binary_join_element_wise(*[s.take(c) for c in codes.T], " ")
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), phrases), "\n")
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(bin_ids)), pa.array(bin_ids), pa.array([pack(x.as_buffer()) for x in texts], type=pa.binary()),
         pa.array([pack(f[i:j].astype("<u4").tobytes()) for i, j in zip(ends[:-1], ends[1:])], type=pa.binary())],
        names=["lang", "bin", "phrases", "counts"])


def _count_pairs(frequent: Bitmap, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, s in _slices(batches):
            if len(s.codes) < 2:
                continue
            h = word_hashes(s.words, lang)
            ok = frequent.has(h)[s.codes]
            at = np.flatnonzero(s.joined[:-1] & ok[:-1] & ok[1:])
            pairs, f = np.unique(s.codes[at] * len(s.words) + s.codes[at + 1], return_counts=True)
            if len(pairs):
                codes = np.stack(np.divmod(pairs, len(s.words)), axis=1)
                yield _packed(lang, s, codes, f, pair_hashes(h[codes[:, 0]], h[codes[:, 1]]), bins)

    return run


def _count_longer(frequent: Bitmap, bins: int, max_words: int):
    """Blocks of the phrases of 3 to ``max_words`` words all of whose pairs are in ``frequent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, s in _slices(batches):
            if len(s.codes) < 3:
                continue
            n = len(s.words)
            h = word_hashes(s.words, lang)
            at = np.flatnonzero(s.joined[:-1])
            ok = np.zeros(len(s.codes), dtype=bool)
            ok[at] = frequent.has(pair_hashes(h[s.codes[at]], h[s.codes[at + 1]]))
            start = np.flatnonzero(ok)
            _, number = np.unique(s.codes[start] * n + s.codes[start + 1], return_inverse=True)
            for size in range(3, max_words + 1):
                more = ok[np.minimum(start + size - 2, len(ok) - 1)] & (start + size <= len(ok))
                start, number = start[more], number[more]
                if not len(start):
                    break
                # a phrase is told by the number of its first words and its last word
                _, where, number, f = np.unique(number * n + s.codes[start + size - 1], return_index=True, return_inverse=True, return_counts=True)
                codes = s.codes[start[where][:, None] + np.arange(size)]
                hashed = h[codes[:, 0]]
                for k in range(1, size):
                    hashed = pair_hashes(hashed, h[codes[:, k]])
                yield _packed(lang, s, codes, f, hashed, bins)

    return run


def _add_up(min_count: int):
    """The blocks of a bin -> (lang, words ARRAY, f) of the phrases that are frequent."""

    def run(blocks: pa.Table) -> pa.Table:
        by_lang: dict[str, list[pa.Table]] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for lang, phrases, counts in zip(*(blocks.column(c) for c in ("lang", "phrases", "counts"))):
            raw = np.frombuffer(unpack(phrases.as_buffer()) + b"\n", dtype=np.uint8)
            f = np.frombuffer(unpack(counts.as_buffer()), dtype="<u4").astype(np.int64)
            ends = np.flatnonzero(raw == 10)  # no word holds a line end: drop them, the others stay in place
            offsets = np.append(0, ends + 1).astype(np.int32)
            offsets -= np.arange(len(offsets), dtype=np.int32)
            column = pa.StringArray.from_buffers(len(f), pa.py_buffer(offsets), pa.py_buffer(raw[raw != 10]))
            by_lang.setdefault(lang.as_py(), []).append(pa.table([column, f], names=["phrase", "f"]))
        out = [pa.table({"lang": pa.array([], pa.string()), "words": pa.array([], pa.list_(pa.string())), "f": pa.array([], pa.int64())})]
        for lang, parts in by_lang.items():
            total = pa.concat_tables(parts).group_by("phrase", use_threads=False).aggregate([("f", "sum")])
            total = total.filter(pc.greater_equal(total.column("f_sum"), min_count))
            words = pc.split_pattern(total.column("phrase"), " ")
            out.append(pa.table({"lang": pa.array([lang] * len(total), pa.string()), "words": words, "f": total.column("f_sum")}))
        return pa.concat_tables(out)

    return run


def _mark(bits: int, width: int):
    """(lang, w1[, w2]) -> (cell, mask) of the bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in table.column("lang").unique().to_pylist():
                rows = table.filter(pc.equal(table.column("lang"), lang)).combine_chunks()
                h = [word_hashes(rows.column(f"w{i + 1}").chunk(0).cast(pa.string()), lang) for i in range(width)]
                at = Bitmap(bits).place(h[0] if width == 1 else pair_hashes(h[0], h[1]))
                cells, where = np.unique(at >> 6, return_inverse=True)
                masks = np.zeros(len(cells), dtype=np.uint64)
                np.bitwise_or.at(masks, where, np.uint64(1) << (at & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(masks.view(np.int64))], names=["cell", "mask"])

    return run


def bitmap(phrases: DataFrame, width: int) -> Bitmap:
    """The bitmap of the hashes of (lang, w1[, w2]) rows. At most 2^MAX_BITS / 64 cells come to the driver."""
    wanted = max(1, BITS_EACH * phrases.count())
    bits = min(MAX_BITS, max(MIN_BITS, wanted.bit_length()))
    marks = phrases.select("lang", *[f"w{i + 1}" for i in range(width)]).mapInArrow(_mark(bits, width), "cell long, mask long")
    found = marks.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    cells = np.zeros(1 << (bits - 6), dtype=np.uint64)
    cells[found.column("cell").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return Bitmap(bits, cells)


def count_streams(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                  max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, words ARRAY, f) of all phrases of 1 to ``max_words`` words with at least ``min_count``
    occurrences, (lang, n) with the number of words)."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    counts = texts.mapInArrow(_count_words, "lang string, w1 string, f long").groupBy("lang", "w1").agg(F.sum("f").alias("f"))
    counts = reliable_checkpoint(counts.filter(F.col("w1").isNull() | (F.col("f") >= min_count)))
    one, totals = counts.filter("w1 is not null"), counts.filter("w1 is null").select("lang", F.col("f").alias("n"))
    bins = max(partitions(spark), -(-(totals.agg(F.sum("n")).first()[0] or 0) // BIN_WORDS))

    def added(count, kept: Bitmap, *more) -> DataFrame:
        blocks = texts.mapInArrow(_with(spark.sparkContext.broadcast(kept), count, bins, *more), "lang string, bin long, phrases binary, counts binary")
        return reliable_checkpoint(blocks.groupBy("bin").applyInArrow(_add_up(min_count), "lang string, words array<string>, f long"))

    streams = one.select("lang", F.array("w1").alias("words"), "f")
    two = added(_count_pairs, bitmap(one, 1))
    streams = streams.union(two)
    if max_words > 2:
        pairs = two.select("lang", F.col("words")[0].alias("w1"), F.col("words")[1].alias("w2"))
        streams = streams.union(added(_count_longer, bitmap(pairs, 2), max_words))
    return streams, totals


def _with(shared, make, *more):
    def run(batches):
        return make(shared.value, *more)(batches)

    return run


def _walk(covered: int, carried):
    """Rows sorted by (lang, words), (lang, words, f, ..., partition): the counts of the first 1, 2, ... words
    of each phrase, and whether it covers the phrase without its last word. ``carried`` holds, for each
    partition, the counts of the first parts of its first phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, counts, lang_now, begun = [], [], None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                lang_now, begun = batch.column(0)[0].as_py(), True
                path = list(batch.column(1)[0].as_py())[:-1]
                counts = carried.value.get(batch.column(batch.num_columns - 1)[0].as_py(), [])
            parts, covers = [], []
            for lang, words, f in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if lang != lang_now:
                    path, counts, lang_now = [], [], lang
                keep = 0
                while keep < len(path) and keep < len(words) - 1 and path[keep] == words[keep]:
                    keep += 1
                if keep != len(words) - 1:
                    raise RuntimeError(f"no count of a part of {words}")
                counts = counts[:keep]
                parts.append(counts)
                covers.append(keep > 1 and 100 * f >= covered * counts[-1])
                path, counts = list(words), [*counts, f]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(parts, type=pa.list_(pa.int64())), pa.array(covers)],
                names=[*batch.schema.names[:-1], "parts", "covers"])

    return run


def walk(streams: DataFrame, covered: int = COVERED, num_partitions: int | None = None) -> DataFrame:
    """Append ``parts`` (counts of the first 1, 2, ... words) and ``covers`` to (lang, words, f, ...)."""
    names = streams.columns
    ranged = range_checkpoint(streams, ["lang"], ["words"], num_partitions)
    first = ranged.groupBy(PID).agg(F.min(F.struct("lang", "words")).alias("k")).select(PID, "k.lang", "k.words")
    heads = first.filter(F.size("words") > 1).select(
        F.col(PID).alias("pid"), "lang", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("size"), "words")
    heads = heads.select("pid", "lang", "size", F.slice("words", 1, F.col("size")).alias("words"))
    # fewer rows than max_words for each partition
    found = ranged.select("lang", "words", "f").join(F.broadcast(heads), ["lang", "words"])
    carried = found.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("size", "f"))).alias("c")).select("pid", "c.f")
    shared = streams.sparkSession.sparkContext.broadcast({r.pid: r.f for r in carried.collect()})
    out = T.StructType([*streams.schema.fields, T.StructField("parts", T.ArrayType(T.LongType())), T.StructField("covers", T.BooleanType())])
    return ranged.select(*names, PID).mapInArrow(_walk(covered, shared), out)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, left, right) -> the lowest of the cuts: l, r, score. Products have any length here."""
    for batch in batches:
        found = []
        for f, left, right in zip(*(batch.column(c).to_pylist() for c in ("f", "left", "right"))):
            cuts = ((SCALE * f // (x + y), k, x, y) for k, (x, y) in enumerate(zip(left, reversed(right))))
            found.append(min(cuts))
        own = [batch.column(c) for c in ("lang", "words", "f")]
        yield pa.RecordBatch.from_arrays([*own, *[pa.array([x[i] for x in found], type=pa.int64()) for i in (2, 3, 0)]],
                                         names=["lang", "words", "f", "l", "r", "score"])


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 covered: int = COVERED, top: int = TOP, num_partitions: int | None = None) -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score) of the first ``top`` phrases of each language."""
    if max_words < 2:
        raise ValueError("phrases have two words or more")
    streams, totals = count_streams(df, text, lang, min_count, max_words)
    forward = walk(streams, covered, num_partitions).select(
        "lang", F.reverse("words").alias("words"), "f", F.col("parts").alias("left"), F.col("covers").alias("covers_first"))
    backward = reliable_checkpoint(walk(forward, covered, num_partitions).filter(F.size("words") > 1).select(
        "lang", F.reverse("words").alias("words"), "f", "left", F.col("parts").alias("right"), "covers_first", "covers"))
    scored = backward.select("lang", "words", "f", "left", "right").mapInArrow(
        _score, "lang string, words array<string>, f long, l long, r long, score long")
    rest = F.size("words") - 1
    gone = backward.filter("covers_first").select("lang", F.slice("words", 1, rest).alias("words")).union(
        backward.filter("covers").select("lang", F.slice("words", F.lit(2), rest).alias("words")))
    kept = scored.join(gone, ["lang", "words"], "left_anti").withColumn("phrase", F.array_join("words", " "))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "words",
                                              F.col("f").alias("a"), "l", "r", "n", "score")
