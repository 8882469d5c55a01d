"""Byte-level BPE encoding and decoding with the rank file of a public tokenizer.

A text is cut into matches of the tokenizer's split pattern; each match is encoded by itself.
Matches of one byte length are the rows of one numpy matrix of token ids (rows of nearby
lengths share a padded matrix). In every round each row merges its leftmost pair of minimum
rank: pair ranks come from an open-addressing hash table over ``(left id, right id)``, the
merged-away column is squeezed out of all rows together, and rows without a mergeable pair are
written out and dropped (compaction), so a round costs what its unfinished rows cost. A match
longer than ``MAX_WIDTH`` bytes is merged in the same order with a heap of (rank, position), as
a matrix of its own would need a round per merge over its full width.

Rows are independent, so this is a map over the text column without a shuffle; the rank table
is broadcast (its size is checked against ``MAX_RANKS``). Repeated words are common, so each
worker keeps the ids of words it has seen, in a cache bounded by entries and bytes.

Results: null text encodes to an empty list, null ids decode to empty bytes. Decoding an id
outside the vocabulary raises. Repeated rows are encoded each by itself, extra columns are kept
and a column named like an output column is replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_slices

MAX_RANKS = 1_000_000
MAX_WIDTH = 192
MATRIX_CELLS = 500_000
SLICE_BYTES = 1_000_000
DECODE_ROWS = 200
CACHE_ENTRIES = 200_000
CACHE_CHARS = 8_000_000
NO_PAIR = np.int32(2**31 - 1)

# The code points with the Unicode property White_Space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                          0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# A run of white space and the word behind it. No match of a split pattern whose only
# look-ahead asks for white space reaches over the end of such a chunk.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes to rank, from lines of ``base64 rank``."""
    out = {}
    for line in lines:
        if line.strip():
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    if len(out) > MAX_RANKS:
        raise ValueError(f"{len(out)} ranks; the broadcast table holds at most {MAX_RANKS}")
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f)


class PairTable:
    """(left id, right id) -> id of the merged token, in open-addressing numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = self._key(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))
        values = np.array(merged, dtype=np.int32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NO_PAIR, dtype=np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(todo):
            free = todo[self.values[slot[todo]] == NO_PAIR]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            lost = np.ones(len(keys), dtype=bool)
            lost[won] = False
            todo = todo[lost[todo]]
            if len(todo):
                slot[todo] = (slot[todo] + 1) & self.mask
                self.probes += 1

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NO_PAIR`` for pairs without a token and for padding (-1)."""
        out = np.full(left.shape, NO_PAIR, dtype=np.int32)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left.ravel()[real], right.ravel()[real])
        slot, flat = self._slot(keys), out.ravel()
        for _ in range(self.probes):
            at = self.keys[slot]
            hit = at == keys
            flat[real[hit]] = self.values[slot[hit]]
            more = ~hit & (self.values[slot] != NO_PAIR)
            if not more.any():
                break
            real, keys, slot = real[more], keys[more], (slot[more] + 1) & self.mask
        return out


class Encoder:
    """Encodes texts by merge ranks; one instance per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.pattern = regex.compile(pattern)
        self.by_letters = r"| ?\p{L}+|" in pattern
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.cached_chars = 0
        self.flat = np.empty(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)

    # -- one match of the pattern ----------------------------------------------------------
    def _matrix(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge every row of a matrix padded with -1; yields (rows, their lengths, their ids)."""
        ranks = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            k, width = np.arange(len(rows)), ids.shape[1]
            if width > 1:
                at = ranks.argmin(axis=1)  # the leftmost of the smallest
                merged = ranks[k, at]
                done = merged == NO_PAIR
            else:
                done = np.ones(len(rows), dtype=bool)
            if done.any():
                real = ids[done]
                yield rows[done], (real >= 0).sum(axis=1), real[real >= 0]
                keep = ~done
                rows, ids = rows[keep], ids[keep]
                if not len(rows):
                    break
                k, ranks, at, merged = np.arange(len(rows)), ranks[keep], at[keep], merged[keep]
            ids[k, at] = merged
            ids = _squeeze(ids, k, at + 1)
            ranks = _squeeze(ranks, k, at)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.pairs.rank(ids[has, at[has] - 1], merged[has])
            has = np.flatnonzero(at < width - 2)
            ranks[has, at[has]] = self.pairs.rank(merged[has], ids[has, at[has] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long match: a heap of (rank, position) over linked parts."""
        ids = self.bytes[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens = {v: k for k, v in self.ranks.items()}
        rank = lambda i: self.ranks.get(tokens[ids[i]] + tokens[ids[after[i]]]) if after[i] < n else None
        heap = [(r, i, ids[i], ids[after[i]]) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue  # a part of the pair was merged meanwhile
            gone = after[i]
            ids[i], ids[gone], after[i] = r, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (x := rank(j)) is not None:
                    heapq.heappush(heap, (x, j, ids[j], ids[after[j]]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each match's ids, their number)."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        found = np.flatnonzero(whole >= 0)
        parts = [(found, np.ones(len(found), dtype=np.int64), whole[found])]
        for i in np.flatnonzero((whole < 0) & (sizes > MAX_WIDTH)).tolist():
            ids = self._long(pieces[i])
            parts.append((np.array([i]), np.array([len(ids)]), ids))
        left = np.flatnonzero((whole < 0) & (sizes <= MAX_WIDTH))
        # exact lengths while short, then padded to the next multiple of 16
        widths = np.where(sizes[left] <= 32, sizes[left], -(-sizes[left] // 16) * 16)
        for width in np.unique(widths).tolist():
            rows = left[widths == width]
            step = max(1, MATRIX_CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                raw = b"".join([pieces[r].ljust(width, b"\0") for r in part.tolist()])
                ids = self.bytes[np.frombuffer(raw, dtype=np.uint8)].reshape(len(part), width)
                if width > 32:
                    ids[np.arange(width) >= sizes[part][:, None]] = -1
                parts.extend(self._matrix(ids, part))
        order = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        starts, lengths = np.empty(len(pieces), dtype=np.int64), np.empty(len(pieces), dtype=np.int64)
        starts[order], lengths[order] = np.cumsum(counts) - counts, counts
        return np.concatenate([p[2] for p in parts]).astype(np.int32), starts, lengths

    # -- texts ------------------------------------------------------------------------------
    def _learn(self, chunks: list[str]) -> None:
        # letters behind at most one space are one match where a run of letters is one
        rows = [[c] if self.by_letters and c[c[0] == " " :].isalpha() else self.pattern.findall(c) for c in chunks]
        matches = list(chain.from_iterable(rows))
        number = {m: i for i, m in enumerate(dict.fromkeys(matches))}
        flat, starts, lengths = self.pieces([m.encode() for m in number])
        at = np.fromiter(map(number.__getitem__, matches), dtype=np.int64, count=len(matches))
        ends = np.cumsum(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)))
        totals = np.concatenate([[0], np.cumsum(lengths[at])])[ends]
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks))))
        self.cached_chars += sum(map(len, chunks))
        self.flat = np.concatenate([self.flat, flat[ragged(starts[at], lengths[at])]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + totals])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        rows = [CHUNK.findall(t) if t else [] for t in texts]
        chunks = list(chain.from_iterable(rows))
        if len(self.index) > CACHE_ENTRIES or self.cached_chars > CACHE_CHARS:
            self._clear()
        new = set(chunks).difference(self.index)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        lengths = self.ends[at + 1] - self.ends[at]
        ids = self.flat[ragged(self.ends[at], lengths)]
        chunk_ends = np.concatenate([[0], np.cumsum(lengths)])
        row_ends = np.cumsum(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)))
        return ids, np.diff(chunk_ends[row_ends], prepend=0)


def _squeeze(matrix: np.ndarray, rows: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The matrix without one cell of each row."""
    stay = np.ones(matrix.shape, dtype=bool)
    stay[rows, column] = False
    return matrix[stay].reshape(len(rows), matrix.shape[1] - 1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``[starts, starts + lengths)``, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        table = [b""] * size
        self.known = np.zeros(size, dtype=bool)
        for token, rank in ranks.items():
            table[rank] = token
            self.known[rank] = True
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.lengths = np.fromiter(map(len, table), dtype=np.int64, count=size)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is outside the vocabulary")
        return self.flat[ragged(self.starts[ids], self.lengths[ids])].tobytes()


_workers: dict = {}


def _worker(call: str, kind, ranks, *args):
    """One encoder or decoder for each call of an operator, kept by a Python worker over its tasks."""
    found = _workers.get((call, kind))
    if found is None:
        if len(_workers) > 4:
            _workers.clear()
        found = _workers[call, kind] = kind(ranks.value, *args)
    return found


def _mapped(df: DataFrame, column: str, keep: Sequence[str] | None, new: dict[str, str], rows) -> DataFrame:
    """Append the columns ``new`` (name -> type), made by ``rows()`` from slices of ``column``, to the
    columns ``keep`` of ``df`` (all), in one Arrow pass that never holds more than a slice's results."""
    names = {k.lower() for k in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    carried = T.StructType([df.schema[c] for c in kept])
    schema = T.StructType([*carried.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in new.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = rows()
        for batch in batches:
            for part, made in make(batch.column(len(kept)), lambda a, b, x=batch: x.slice(a, b - a)):
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], *made], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias("_llm_input")).mapInArrow(run, schema)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))


def _decode_rows(decoder: Decoder, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.cumsum(counts)
    return pa.array([decoder.decode(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())], type=pa.binary())


def encode_documents(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids",
                     decoded: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Append ``out``: the token ids (ARRAY<INT>) of every whole text; with ``decoded`` also the bytes
    that the ids decode to (BINARY), in the same pass. ``keep``: the columns of ``df`` to carry."""
    shared, call = df.sparkSession.sparkContext.broadcast(ranks), uuid4().hex

    def rows():
        encoder = _worker(call, Encoder, shared, pattern)
        decoder = _worker(call, Decoder, shared) if decoded else None

        def make(column, part):
            for a, b in arrow_slices(column, SLICE_BYTES):
                ids, counts = encoder.encode(column.slice(a, b - a).to_pylist())
                made = [_lists(ids, counts)]
                if decoder:
                    made.append(_decode_rows(decoder, ids.astype(np.int64), counts))
                yield part(a, b), made

        return make

    return _mapped(df, text, keep, {out: "array<int>"} | ({decoded: "binary"} if decoded else {}), rows)


def decode_documents(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded",
                     keep: Sequence[str] | None = None) -> DataFrame:
    """Append ``out``: the bytes of the token ids (BINARY)."""
    shared, call = df.sparkSession.sparkContext.broadcast(ranks), uuid4().hex

    def rows():
        decoder = _worker(call, Decoder, shared)

        def make(column, part):
            for a in range(0, len(column), DECODE_ROWS):
                lists = column.slice(a, DECODE_ROWS)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                yield part(a, a + len(lists)), [_decode_rows(decoder, values, counts)]

        return make

    return _mapped(df, ids, keep, {out: "binary"}, rows)
