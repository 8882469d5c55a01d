"""Language-model scoring with a probabilistic suffix tree over the bytes of normalised texts.

A text is its words (A-Z lower-cased) joined by one space and closed by an end symbol; symbols are
UTF-8 bytes and the end. The tree's contexts are the last 0 to ``DEPTH`` symbols. A context is a
candidate when it was seen at least ``MIN_COUNT`` times, a fixed number, so that the tree grows with
the corpus. A candidate is retained when its next-symbol distribution diverges from that of its retained parent (Kullback-Leibler
divergence of at least ``MIN_DIVERGENCE`` nats), or when a longer retained context ends in it, so
the tree is closed under suffixes. Distributions are smoothed by Witten-Bell interpolation with the
parent's, down to the uniform one. A symbol is scored by the longest retained suffix of its past.

Counting covers the whole training corpus: each task counts the windows of ``DEPTH + 1`` symbols
of its texts (numpy and a hash table, merged before they leave the task), Spark adds them up, and
the counts of shorter contexts follow from those. Contexts of up to ``TOP`` symbols, whose number the
alphabet bounds, are gathered and broadcast. The longer ones are a checkpointed table, dealt into
buckets by their last ``TOP + 1`` symbols, so that a bucket holds what smoothing, pruning and looking up
its contexts need. As for words, a block asks each bucket once for its distinct windows. Buckets and
requests are sorted together and streamed: a task holds one bucket's contexts and a batch of requests, and
the requests of a bucket are dealt over groups whose number follows the data.

Word counts (``base_score``) need the exact count of every word of every document, and the
vocabulary grows with the corpus, so it is never gathered: documents are dealt into blocks of
about ``BLOCK_CHARS`` characters by id and text; a block asks once for each distinct word, the requests
are added up over all blocks by word, and the answers go back to the block, many in one value. A word is known by its
64-bit hash (two words share one with a chance of about n^2 / 2^65 over n distinct words).

Results: null text is empty (only the end symbol). Without training rows N and V are 0, so
``base_score`` is 0, and the tree is uniform. Repeated rows are scored each by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_slices, reliable_checkpoint

DEPTH = 5
MIN_COUNT = 2
TOP = 2
MIN_DIVERGENCE = 0.005
BLOCK_CHARS = 12_000_000
SMALL_SLICE = 400_000  # arrays of a slice stay in the processor caches
MERGE_ROWS = 3_000_000
MAX_BUCKETS = 1024
LOOK_UP_BYTES = 4_000_000  # of requests and answers in an output batch
ASK_WORDS = 1_500_000
# Bytes that occur in no UTF-8 text: the end symbol, and what stands before the first symbol.
END, START = 0xFE, 0xFF
ALPHABET = 257  # the uniform distribution below the tree: all byte values and the end
CACHE_BITS = 20


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, each behind DEPTH start symbols; number of symbols of each text)."""
    lines = [b" ".join(t.encode().lower().split()) if t else b"" for t in texts]
    start, end = bytes([START]) * DEPTH, bytes([END])
    joined = start + (end + start).join(lines) + end if lines else b""
    return np.frombuffer(joined, dtype=np.uint8), np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) + 1


def windows(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the DEPTH + 1 symbols that end at each position, positions), start symbols left out."""
    at = np.flatnonzero(raw != START)
    code = np.zeros(len(raw), dtype=np.uint64)
    for k in range(DEPTH + 1):
        code[k:] |= raw[: len(raw) - k].astype(np.uint64) << np.uint64(8 * k)
    return code[at], at


def _counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    number, distinct = pd.factorize(codes)
    return np.asarray(distinct), np.bincount(number, weights, len(distinct)).astype(np.int64)


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([np.empty(0, dtype=np.uint64), *[p[0] for p in parts]])
        return _counted(codes, np.concatenate([np.empty(0), *[p[1] for p in parts]]))

    def out() -> pa.RecordBatch:
        codes, counts = merged()
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], names=["code", "n"])

    for batch in batches:
        column = batch.column(0)
        for a, b in arrow_slices(column, SMALL_SLICE):
            parts.append(_counted(windows(symbols(column.slice(a, b - a).to_pylist())[0])[0]))
            if sum(len(p[0]) for p in parts) > MERGE_ROWS:
                parts[:] = [merged()]
                if len(parts[0][0]) > MERGE_ROWS // 2:
                    yield out()
    yield out()


def context_counts(texts: DataFrame, p_min: float = 0.0, min_count: int = 1) -> DataFrame:
    """(length, code, n, total) of the candidate contexts, those seen ``min_count`` times and in the share
    ``p_min`` of all symbols: ``code`` holds the context and the next symbol, ``n`` its count, ``total``
    that of the context. ``texts`` has one text column."""
    counted = texts.mapInArrow(_count_windows, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    counted = reliable_checkpoint(counted)
    least = max(min_count, p_min * (counted.agg(F.sum("n")).first()[0] or 0) if p_min else 0)
    masks = F.array(*[F.struct(F.lit(k).alias("length"),
                               F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("code"))
                      for k in range(DEPTH + 1)])
    each = counted.select(F.explode(masks).alias("c"), "n").groupBy("c.length", "c.code").agg(F.sum("n").alias("n"))
    context = Window.partitionBy("length", F.shiftrightunsigned("code", 8))
    return each.withColumn("total", F.sum("n").over(context)).filter(F.col("total") >= float(least))


class Tree:
    """The retained contexts: for each length, sorted codes with log10 probabilities, and sorted
    contexts with the log10 share they leave to their parent."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels  # (codes, log10 p, contexts, log10 backoff)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 P(last symbol | the symbols before) of windows."""
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(len(self.levels) - 1, -1, -1):
            known, logp, contexts, backoff = self.levels[k]
            if not len(contexts) or not len(todo):
                continue
            code = codes[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            context = code >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            state = contexts[at] == context  # the longest retained suffix, or one it backs off to
            i = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = state & (known[i] == code)
            out[todo[hit]] += logp[i[hit]]
            out[todo[state & ~hit]] += backoff[at[state & ~hit]]
            todo = todo[~hit]
        out[todo] -= np.log10(ALPHABET)
        return out


def _smoothed(rows: pd.DataFrame, lengths: range, above: tuple[np.ndarray, np.ndarray], min_divergence: float) -> dict:
    """length -> (codes, p, contexts, their first code, number of symbols and total, contexts that diverge)
    of the candidates; ``above`` is (codes, p) of the length before the first."""
    out = {}
    for k in lengths:
        r = rows[rows["length"] == k]
        code = r["code"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(code)
        code, n, total = code[order], r["n"].to_numpy(dtype=np.float64)[order], r["total"].to_numpy(dtype=np.float64)[order]
        context, first, kinds = np.unique(code >> np.uint64(8), return_index=True, return_counts=True)
        kinds_of = np.repeat(kinds, kinds).astype(np.float64)
        if k == 0:
            parent = np.full(len(code), 1.0 / ALPHABET)
        else:  # a symbol seen in a context was seen in its parent, and the parent is a candidate
            parent = above[1][np.searchsorted(above[0], code & np.uint64((1 << 8 * k) - 1))]
        p = (n + kinds_of * parent) / (total + kinds_of)
        share = n / total
        divergence = np.add.reduceat(share * np.log(share / parent), first) if len(code) else np.empty(0)
        out[k] = (code, p, context, kinds, total[first] if len(code) else total, context[(divergence >= min_divergence) | (k == 0)])
        above = code, p
    return out


def _retained(smoothed: dict, kept: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The levels of a tree; ``kept`` are the retained contexts one longer than the last."""
    out = []
    for k in sorted(smoothed, reverse=True):  # a retained context retains its suffixes
        code, p, context, kinds, total, passed = smoothed[k]
        kept = np.union1d(passed, kept & np.uint64((1 << 8 * k) - 1)) if k else passed
        stay = np.isin(context, kept)
        rows_stay = np.repeat(stay, kinds)
        out.append((code[rows_stay], np.log10(p[rows_stay]), context[stay], np.log10(kinds[stay] / (total[stay] + kinds[stay]))))
    return out[::-1]


_NONE = np.empty(0, dtype=np.uint64)


def fit_tree(rows: pd.DataFrame, min_divergence: float = MIN_DIVERGENCE) -> Tree:
    """Smooth and prune the candidate contexts (length, code, n, total)."""
    return Tree(_retained(_smoothed(rows, range(DEPTH + 1), (_NONE, np.empty(0)), min_divergence), _NONE))


_DEAL = 2654435761
_SUFFIX = (1 << 8 * (TOP + 1)) - 1


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the last TOP + 1 symbols of the contexts."""
    key = (codes >> np.uint64(8)) & np.uint64(_SUFFIX)
    return ((key * np.uint64(_DEAL) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _bucket_column(buckets: int) -> Column:
    key = F.shiftright("code", 8).bitwiseAND(F.lit(_SUFFIX))
    return F.shiftright(key * F.lit(_DEAL), 16) % F.lit(buckets).cast("long")


def _fit_bucket(above, min_divergence: float):
    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        levels = _retained(_smoothed(rows.to_pandas(), range(TOP + 1, DEPTH + 1), above.value, min_divergence), _NONE)
        out = []
        for k, (codes, logp, contexts, backoff) in enumerate(levels, TOP + 1):
            left = backoff[np.searchsorted(contexts, codes >> np.uint64(8))]
            out.append(pa.table({"bucket": np.full(len(codes), bucket), "length": np.full(len(codes), k, dtype=np.int32),
                                 "code": codes.view(np.int64), "logp": logp, "backoff": left}))
        return pa.concat_tables(out)

    return run


def fit_table(candidates: DataFrame, buckets: int, min_divergence: float = MIN_DIVERGENCE) -> tuple[Tree, DataFrame]:
    """The tree of the candidates: contexts of up to TOP symbols, and a table (bucket, length, code, logp,
    backoff) of the longer ones."""
    spark = candidates.sparkSession
    short = candidates.filter(F.col("length") <= TOP).toArrow().to_pandas()
    smoothed = _smoothed(short, range(TOP + 1), (_NONE, np.empty(0)), min_divergence)
    above = spark.sparkContext.broadcast(smoothed[TOP][:2])
    longer = candidates.filter(F.col("length") > TOP).withColumn("bucket", _bucket_column(buckets))
    longer = longer.groupBy("bucket").applyInArrow(
        _fit_bucket(above, min_divergence), "bucket bigint, length int, code bigint, logp double, backoff double")
    longer = reliable_checkpoint(longer)
    suffix = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))
    kept = longer.filter(F.col("length") == TOP + 1).select(suffix.alias("c")).distinct().toArrow()
    return Tree(_retained(smoothed, kept.column("c").to_numpy().astype(np.uint64))), longer


# The bytes of a code in the order in which packed codes are sorted, the first counts least: context
# symbols before the last TOP + 1, the next symbol, the last context symbols.
_PACKED = [*range(DEPTH, TOP + 1, -1), 0, *range(TOP + 1, 0, -1)]


def pack(codes: np.ndarray) -> bytes:
    """Sorted by their last symbols, a bucket's codes take about one byte each."""
    moved = np.zeros((len(codes), 8), dtype=np.uint8)
    moved[:, : DEPTH + 1] = codes.view(np.uint8).reshape(-1, 8)[:, _PACKED]
    moved = np.sort(moved.view(np.uint64).ravel()).view(np.uint8).reshape(-1, 8)[:, : DEPTH + 1]
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(moved.T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    moved = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(DEPTH + 1, -1)
    codes = np.zeros((moved.shape[1], 8), dtype=np.uint8)
    codes[:, _PACKED] = moved.T
    return codes.view(np.uint64).ravel()


def pack_scores(scores: np.ndarray) -> bytes:
    """Scores repeat where windows back off to the same context: sorted distinct values, then a number each."""
    values, number = np.unique(scores, return_inverse=True)
    width = 2 if len(values) <= 1 << 16 else 4
    columns = [a.view(np.uint8).reshape(-1, k).T.tobytes() for a, k in ((values, 8), (number.astype(f"<u{width}"), width))]
    head = np.array([len(values), len(scores)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(columns))


def unpack_scores(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    n_values, n = raw[:16].view(np.int64).tolist()
    width = 2 if n_values <= 1 << 16 else 4
    values = np.ascontiguousarray(raw[16 : 16 + 8 * n_values].reshape(8, -1).T).view(np.float64).ravel()
    number = np.ascontiguousarray(raw[16 + 8 * n_values :].reshape(width, n).T).view(f"<u{width}").ravel()
    return values[number]


LOOKED_UP = "block bigint, codes binary, scores binary"


def _look_up(top):
    """Rows sorted by (bucket, salt), a bucket's contexts before what is asked of them -> (block, codes,
    scores). One bucket's contexts and one batch of requests are held at a time."""

    def levels_of(parts: list[tuple[np.ndarray, ...]]) -> Tree:
        length, code, logp, backoff = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, dtype=np.uint64),) * 4
        levels = list(top.value)
        for k in range(TOP + 1, DEPTH + 1):
            at = np.flatnonzero(length == k)
            at = at[np.argsort(code[at])]
            contexts, first = np.unique(code[at] >> np.uint64(8), return_index=True)
            levels.append((code[at], logp[at], contexts, backoff[at][first]))
        return Tree(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, salt = batch.column("bucket").to_numpy(), batch.column("salt").to_numpy()
            asks = pc.is_valid(batch.column("block")).to_numpy(zero_copy_only=False)
            change = (np.diff(bucket) != 0) | (np.diff(salt) != 0) | (asks[1:] != asks[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            blocks, codes, scores, held = [], [], [], 0
            for a, b in zip(edges, edges[1:]):
                if (bucket[a], salt[a]) != group:
                    group, parts, tree = (bucket[a], salt[a]), [], None
                rows = batch.slice(a, b - a)
                if not asks[a]:
                    length, code, logp, backoff = (rows.column(c).to_numpy() for c in ("length", "code", "logp", "backoff"))
                    parts.append((length, code.view(np.uint64), logp, backoff))
                    continue
                if tree is None:
                    tree, parts = levels_of(parts), []
                for block, blob in zip(rows.column("block"), rows.column("codes")):
                    asked = blob.as_py()
                    blocks.append(block.as_py())
                    codes.append(asked)
                    scores.append(pack_scores(tree.score(unpack(asked))))
                    held += len(asked) + len(scores[-1])
                    if held > LOOK_UP_BYTES:
                        yield _looked_up(blocks, codes, scores)
                        blocks, codes, scores, held = [], [], [], 0
            yield _looked_up(blocks, codes, scores)

    return run


def _looked_up(blocks: list[int], codes: list[bytes], scores: list[bytes]) -> pa.RecordBatch:
    arrays = [pa.array(blocks, pa.int64()), pa.array(codes, pa.binary()), pa.array(scores, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "codes", "scores"])


def look_up_windows(asked: DataFrame, longer: DataFrame, top, salts: int) -> DataFrame:
    """(block, codes, scores) of the requests (block, bucket, codes). The requests of a bucket are dealt
    over ``salts`` groups, each with a copy of the bucket's contexts, whose number the alphabet bounds."""
    contexts = longer.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "length", "code", "logp", "backoff")
    requests = asked.select("bucket", F.pmod("block", F.lit(salts)).cast("int").alias("salt"), "block", "codes")
    rows = contexts.unionByName(requests, allowMissingColumns=True).repartition("bucket", "salt")
    rows = rows.sortWithinPartitions("bucket", "salt", F.col("block").asc_nulls_first())
    return rows.mapInArrow(_look_up(top), LOOKED_UP)


def _ask_windows(buckets: int):
    """Rows of a block partition (id, text, train, block) -> (block, bucket, codes): a block's distinct
    windows, once in a run of about ``MERGE_ROWS`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        held = 0

        def merge() -> int:
            for k, p in parts.items():
                parts[k] = [pd.unique(np.concatenate(p))]
            return sum(len(p[0]) for p in parts.values())

        def out() -> Iterator[pa.RecordBatch]:
            for k, p in parts.items():
                codes = p[0]
                bucket = bucket_of(codes, buckets)
                order = np.argsort(bucket, kind="stable")
                asked, first = np.unique(bucket[order], return_index=True)
                blobs = [pack(c) for c in np.split(codes[order], first[1:])] if len(codes) else []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), k)), pa.array(asked), pa.array(blobs, pa.binary())],
                                                 names=["block", "bucket", "codes"])
            parts.clear()

        for batch in batches:
            column, blocks = batch.column(1), batch.column(3).to_numpy()
            for a, b in arrow_slices(column, SMALL_SLICE):
                texts, of = column.slice(a, b - a).to_pylist(), blocks[a:b]
                for k in np.unique(of).tolist():
                    codes = pd.unique(windows(symbols([texts[i] for i in np.flatnonzero(of == k)])[0])[0])
                    parts.setdefault(k, []).append(codes)
                    held += len(codes)
                if held > MERGE_ROWS:
                    held = merge()
                    if held > MERGE_ROWS // 2:
                        yield from out()
                        held = 0
        merge()
        yield from out()

    return run


class Answers:
    """The scores of a block's windows, as its buckets answered."""

    def __init__(self, codes: list[bytes], scores: list[bytes]):
        known = np.concatenate([_NONE, *map(unpack, codes)])
        self.known, at = np.unique(known, return_index=True)
        self.scores = np.concatenate([np.empty(0), *map(unpack_scores, scores)])[at]

    def score(self, codes: np.ndarray) -> np.ndarray:
        return self.scores[np.searchsorted(self.known, codes)]


class Scorer:
    """Scores texts; windows repeat, so scores are kept in a direct-mapped table of fixed size."""

    def __init__(self, tree: Tree | Answers):
        self.tree = tree
        self.keys = np.full(1 << CACHE_BITS, np.uint64(2**64 - 1))
        self.values = np.zeros(1 << CACHE_BITS)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text."""
        raw, counts = symbols(texts)
        codes, _ = windows(raw)
        slot = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        scores, miss = self.values[slot], np.flatnonzero(self.keys[slot] != codes)
        if len(miss):
            number, distinct = pd.factorize(codes[miss])
            found = self.tree.score(np.asarray(distinct))
            scores[miss] = found[number]
            self.keys[slot[miss]], self.values[slot[miss]] = codes[miss], scores[miss]
        return np.add.reduceat(scores, np.cumsum(counts) - counts) if len(counts) else np.empty(0)


# -- words -------------------------------------------------------------------------------------

_POWER = np.uint64(0x5851F42D4C957F2D | 1)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SALT = np.random.RandomState(11).randint(0, 2**63, 256).astype(np.uint64)


_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers, kept for slices of the usual size."""
    table = _tables.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 2 * SMALL_SLICE), base)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= 2 * SMALL_SLICE:
            _tables[int(base)] = table
    return table[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the lower-cased words of all texts, number of words of each text)."""
    parts = [t.encode() if t else b"" for t in texts]
    raw = np.frombuffer(b"\n".join(parts).translate(_UPPER_TO_LOWER) + b"\n", dtype=np.uint8)
    space = _SPACE[raw]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_SALT[raw] * _powers(_POWER, len(raw)), dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + (ends - starts).astype(np.uint64)
    text_ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    before = np.searchsorted(starts, text_ends)
    return h, np.diff(before, prepend=0)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block partition (id, text, train, block) -> (block, word, n): n in training texts. A
    word comes once for each block in a run of about ``ASK_WORDS`` words."""
    for batch in batches:
        blocks, train = batch.column(3).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        column, parts, first = batch.column(1), [], 0
        for a, b in arrow_slices(column, SMALL_SLICE):
            parts.append(word_hashes(column.slice(a, b - a).to_pylist()))
            if b < len(column) and sum(len(p[0]) for p in parts) < ASK_WORDS:
                continue
            h = np.concatenate([p[0] for p in parts])
            of = np.repeat(np.arange(first, b), np.concatenate([p[1] for p in parts]))
            for k in np.unique(blocks[first:b]).tolist():
                here = blocks[of] == k
                words, counts = _counted(h[here], train[of[here]].astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), k)), pa.array(words.view(np.int64)), pa.array(counts)],
                    names=["block", "word", "n"])
            parts, first = [], b


def pack_words(words: np.ndarray, counts: np.ndarray) -> bytes:
    order = np.argsort(words)
    columns = [words[order].astype("<u8"), counts[order].astype("<i8").view("<u8")]
    raw = b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(1).compress(raw)


def unpack_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(2, 8, -1)
    words, counts = (np.ascontiguousarray(c.T).view(np.int64).ravel() for c in raw)
    return words, counts


def _pack_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, c, first) -> (block, words): a block's words of a run of about ``ASK_WORDS`` rows in
    one value, with their counts, which are negative where the block is the first that asked."""
    parts, held = [], 0

    def out() -> pa.RecordBatch:
        block, word, c = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(block, kind="stable")
        of, first = np.unique(block[order], return_index=True)
        blobs = [pack_words(word[at], c[at]) for at in np.split(order, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(blobs, pa.binary())], names=["block", "words"])

    for batch in batches:
        block, word, c, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("block", "word", "c", "first"))
        parts.append((block, word, np.where(first, -c, c)))
        held += len(block)
        if held > ASK_WORDS:
            yield out()
            parts, held = [], 0
    if held:
        yield out()


ANSWER = "id bigint, train boolean, block bigint, n_words bigint, n_known bigint, log_sum double, score double, new_words bigint"


def _answer_block():
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        of_window = pc.is_valid(answers.column("codes"))
        looked_up = answers.select(["codes", "scores"]).filter(of_window)
        scorer = Scorer(Answers(looked_up.column("codes").to_pylist(), looked_up.column("scores").to_pylist()))
        words = [unpack_words(w) for w in answers.column("words").filter(pc.invert(of_window)).to_pylist()]
        keys, signed = (np.concatenate([np.empty(0, dtype=np.int64), *c]) for c in (zip(*words) if words else ((), ())))
        known = pd.Index(keys)
        counts = np.append(np.abs(signed), 0)
        new = int(np.sum(signed < 0))
        out = []
        docs = docs.combine_chunks()
        column = docs.column("text").chunk(0) if len(docs) else pa.array([], type=pa.string())
        for start, end in arrow_slices(column, SMALL_SLICE):
            batch = docs.slice(start, end - start)
            texts = batch.column("text").to_pylist()
            h, n = word_hashes(texts)
            c = counts[known.get_indexer(h.view(np.int64))]
            of = np.repeat(np.arange(len(texts)), n)
            total = lambda x: np.bincount(of, x, len(texts))  # noqa: E731, B023
            out.append(pa.table({
                "id": batch.column("id"), "train": batch.column("train"), "block": batch.column("block"),
                "n_words": n, "n_known": total(c > 0).astype(np.int64), "log_sum": total(np.log10(c + 1.0)),
                "score": scorer(texts), "new_words": np.full(len(texts), new)}))
        schema = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("block", pa.int64()), ("n_words", pa.int64()),
                            ("n_known", pa.int64()), ("log_sum", pa.float64()), ("score", pa.float64()), ("new_words", pa.int64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return run


def score_documents(df: DataFrame, train: Column, id: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT,
                    min_divergence: float = MIN_DIVERGENCE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score): learns from the rows where
    ``train`` holds (null: does not) and scores all."""
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                     F.coalesce(train, F.lit(False)).alias("train"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    # a block has a row a bucket; beyond MAX_BUCKETS a bucket's requests are dealt over several groups
    buckets = min(MAX_BUCKETS, 32 * math.ceil(math.sqrt(blocks)))
    salts = math.ceil(blocks / (8 * buckets))
    candidates = context_counts(rows.filter("train").select("text"), min_count=min_count)
    tree, longer = fit_table(candidates, buckets, min_divergence)
    top = spark.sparkContext.broadcast(tree.levels)
    dealt = rows.select("id", "text", "train", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block")) \
        .repartition(2 * blocks, "block")  # more partitions than blocks, so that few blocks share one
    # all columns, so that asking and answering read the same exchange of the texts
    asked = dealt.mapInArrow(_ask, "block bigint, word bigint, n bigint")
    asked = asked.groupBy("word", "block").agg(F.sum("n").alias("n"))
    by_word = Window.partitionBy("word")
    answers = asked.select("block", "word", F.sum("n").over(by_word).alias("c"),
                           (F.col("block") == F.min("block").over(by_word)).alias("first")) \
        .filter("c > 0")  # a word without an answer is unknown
    asked_windows = dealt.mapInArrow(_ask_windows(buckets), "block bigint, bucket bigint, codes binary")
    looked_up = look_up_windows(asked_windows, longer, top, salts)
    answers = answers.mapInArrow(_pack_answers, "block bigint, words binary")
    answers = answers.unionByName(looked_up, allowMissingColumns=True)
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answer_block(), ANSWER)
    found = reliable_checkpoint(found)
    # distinct words, each counted in the first block that asked for it
    v = found.groupBy("block").agg(F.max("new_words").alias("v")).agg(F.sum("v")).first()[0] or 0
    n = found.filter("train").agg(F.sum("n_words"), F.count("*")).first()
    ends = n[1]
    tokens = (n[0] or 0) + ends
    v += 1 if ends else 0
    size = F.col("n_words") + 1
    base = F.col("log_sum") + F.log10(F.lit(ends + 1.0)) - size * F.log10(F.lit(float(tokens + v + 1)))
    return found.select(
        F.col("id"), "train", size.alias("n_tokens"), (F.col("n_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
