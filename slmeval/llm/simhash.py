"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints within ``d`` differing bits share at
least ``m = 8 - d`` of them, the guaranteed minimum of matches. The inverted index holds a
posting for each (set of positions, their byte values); the position sets are a cover: any
``m`` of the eight positions contain one of them, so every pair within the distance meets in a
posting. Inside a posting the shared positional bytes of a pair are tallied, pairs with fewer
than ``m`` are dropped and the rest are verified by their differing bits.

Scale: equal fingerprints are one node, so copies cost nothing. Position sets have two or three
bytes, by the number of fingerprints (both find every link). A posting is compared by one task
up to ``BLOCK`` fingerprints; a larger one (a big group of near copies shares most bytes) is
salted into blocks, each compared by itself, and only links that still join two components are
searched between blocks: the members outside the posting's largest component against every
block. A task writes a spanning forest of each posting, never all its pairs. Nothing is capped.

Results: a text without words has fingerprint zero and is linked like any other; a null text is
an empty one. ``component_id`` is the smallest id reachable, itself included (null ids are linked
but never named; a component of null ids only has a null one). Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, partitions, reliable_checkpoint
from .components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCK = 2048
FEW = 8  # postings up to this size are compared pair by pair, vectorised over postings
POSTING = 256  # mean fingerprints of a posting beyond which position sets get a byte more


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased (A-Z) word shingles of one text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    hash_of, view = xxhash.xxh64_intdigest, memoryview(line)
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        part = [hash_of(view[a:b], SEED) for a, b in zip(starts[i : min(n, i + 65536)].tolist(), last[i : i + 65536].tolist())]
        raw = np.array(part, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * bits > n).tolist())


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The SimHash of a text column as BIGINT (its 64 bits, signed)."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = [fingerprint(x.as_py(), shingle) for x in batch]
            yield pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return simhash(text)


def position_sets(size: int, shared: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the 8 byte positions such that any ``shared`` positions contain one.

    Two covers, the smaller is used: all sets of the first ``8 - (shared - size)`` positions, or
    the sets inside each of g groups of positions (with g groups, any ``shared`` positions have
    ceil(shared / g) in one group, which must reach ``size``).
    """
    first = list(combinations(range(8 - (shared - size)), size))
    groups = (shared - 1) // (size - 1) if size > 1 else 1
    dealt = [c for i in range(groups) for c in combinations(range(i, 8, groups), size)] if size > 1 else first
    return min(first, dealt, key=len)


def _set_size(nodes: int, shared: int) -> int:
    """Bytes of a position set: one more as soon as a mean posting exceeds ``POSTING``."""
    size = min(2, shared)
    while size < shared and nodes / 256**size > POSTING:
        size += 1
    return size


def _posting_keys(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    """ARRAY<BIGINT>: (set number, bytes at its positions) of one fingerprint."""
    keys = []
    for k, positions in enumerate(sets):
        key = F.lit(k).cast("long")
        for p in positions:
            byte = F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))
            key = F.shiftleft(key, 8).bitwiseOR(byte)
        keys.append(key)
    return F.array(*keys)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Tally the shared positional bytes of each pair, keep those with enough, verify their bits."""
    x = np.ascontiguousarray(a ^ b)
    enough = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1, dtype=np.int8) >= 8 - bits
    at = np.flatnonzero(enough)
    enough[at] = np.bitwise_count(x[at]) <= bits
    return enough


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that span the components of one posting (or block), found breadth first."""
    left, out = np.arange(len(fp)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = _near(fp[left], fp[i], bits)
            if hit.any():
                found = left[hit].tolist()
                out.extend((i, j) for j in found)
                todo.extend(found)
                left = left[~hit]
    return out


def _postings(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows sorted by (key, salt, ...) -> (starts of the whole postings, lengths, columns)."""
    rest = None
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(width)])
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        if not rows.shape[1]:
            continue
        new = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
        if len(new):
            cut = int(new[-1])
            starts = np.concatenate([[0], new[:-1]])
            yield starts, np.diff(np.append(starts, cut)), rows[:, :cut]
            rest = rows[:, cut:]
        else:
            rest = rows
    if rest is not None and rest.shape[1]:
        yield np.zeros(1, dtype=np.int64), np.array([rest.shape[1]]), rest


def _batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, dtype=np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _link_blocks(bits: int):
    """Links inside every posting block: columns key, salt, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, lengths, rows in _postings(batches, 3):
            fp, out = rows[2], []
            values = fp.view(np.uint64)
            small = np.flatnonzero((lengths > 1) & (lengths <= FEW))
            for d in range(1, FEW):
                small = small[lengths[small] > d]
                for e in range(FEW - d):
                    at = starts[small[lengths[small] > d + e]] + e
                    if not len(at):
                        break
                    hit = at[_near(values[at], values[at + d], bits)]
                    out.append((fp[hit], fp[hit + d]))
            for k in np.flatnonzero(lengths > FEW).tolist():
                block = slice(starts[k], starts[k] + lengths[k])
                links = _forest(values[block], bits)
                if links:
                    i, j = np.array(links).T
                    out.append((fp[block][i], fp[block][j]))
            yield _batch(out)

    return run


def _link_between(bits: int):
    """Links of a large posting's minor members with each block: key, salt, fp, component, probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, lengths, rows in _postings(batches, 5):
            out = []
            for a, n in zip(starts.tolist(), lengths.tolist()):
                fp, component, probe = rows[2, a : a + n], rows[3, a : a + n], rows[4, a : a + n] == 1
                values, own = fp.view(np.uint64), ~probe
                for i in np.flatnonzero(probe).tolist():
                    hit = np.flatnonzero(own & (component != component[i]))
                    hit = hit[_near(values[hit], values[i], bits)]
                    if len(hit):  # one link for each other component it reaches
                        hit = hit[np.unique(component[hit], return_index=True)[1]]
                        out.append((np.full(len(hit), fp[i]), fp[hit]))
            yield _batch(out)

    return run


def near_links(nodes: DataFrame, bits: int = MAX_BITS, block: int = BLOCK, set_size: int | None = None) -> DataFrame:
    """Distinct fingerprints (column ``fp``) -> (node, component) of those linked by ``bits`` or
    fewer differing bits; fingerprints without a link are absent. ``bits`` may be 0 to 7."""
    if not 0 <= bits <= 7:
        raise ValueError("the byte-position index guarantees a shared byte for 0 to 7 differing bits")
    shared = 8 - bits
    if set_size is None:
        set_size = _set_size(nodes.count(), shared)
    sets = position_sets(set_size, shared)
    index = nodes.select("fp", F.explode(_posting_keys(F.col("fp"), sets)).alias("key"))
    sizes = index.groupBy("key").count()
    large = reliable_checkpoint(sizes.filter(F.col("count") > block).select(
        "key", F.ceil(F.col("count") / block).cast("long").alias("blocks")))
    any_large = not large.isEmpty()
    if any_large:
        salt = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")), F.lit(0).cast("long"))
        index = index.join(large, "key", "left").select("key", salt.alias("salt"), "fp")
    else:
        index = index.select("key", F.lit(0).cast("long").alias("salt"), "fp")
    dealt = index.repartition(partitions(nodes.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", "fp")
    links = reliable_checkpoint(dealt.mapInArrow(_link_blocks(bits), "a bigint, b bigint").distinct())
    found = connected_components(links)
    if not any_large:
        return found
    # Large postings: what the blocks' components leave apart
    found = reliable_checkpoint(found)
    members = index.join(large, "key").join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "salt", "blocks", "fp", F.coalesce("component", "fp").alias("component"))
    members = reliable_checkpoint(members)
    per = members.groupBy("key", "component").count()
    main = per.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"),
                                  F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    main = reliable_checkpoint(main)
    members = members.join(main, "key")
    probes = members.filter("component <> main").select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"), "fp", "component",
        F.lit(1).cast("long").alias("probe"))
    both = members.select("key", "salt", "fp", "component", F.lit(0).cast("long").alias("probe")).union(probes)
    dealt = both.repartition(partitions(nodes.sparkSession), "key", "salt").sortWithinPartitions("key", "salt")
    more = dealt.mapInArrow(_link_between(bits), "a bigint, b bigint").distinct()
    return connected_components(links.union(more))


def _classified(df: DataFrame, id: str, text: str, shingle: int, bits: int) -> DataFrame:
    """(id, text_hash, fingerprint BIGINT, component, component_id) of each row; ``component`` is the
    smallest fingerprint of the component, which tells components apart where an id is repeated."""
    marks = reliable_checkpoint(df.select(
        F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"),
        fingerprint_column(F.col(text), shingle).alias("fp")))
    prints = reliable_checkpoint(marks.groupBy("fp").agg(F.min("id").alias("first")))
    linked = near_links(prints.select("fp"), bits).withColumnRenamed("node", "fp")
    named = reliable_checkpoint(prints.join(linked, "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")))
    least = reliable_checkpoint(named.groupBy("component").agg(F.min("first").alias("component_id")))
    classes = reliable_checkpoint(named.join(least, "component").select("fp", "component", "component_id"))
    return marks.join(classes, "fp").select("id", "text_hash", F.col("fp").alias("fingerprint"), "component", "component_id")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    bits: int = MAX_BITS) -> DataFrame:
    """(id, text_hash, fingerprint BIGINT, component_id), one row for each row of ``df``.

    ``text_hash`` (XXH64 of the text) tells rows with a repeated id apart.
    """
    return _classified(df, id, text, shingle, bits).drop("component")


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` with one document of each component: that with the smallest id (of equal
    ids, the smallest text hash; of rows equal in both, one). Columns are those of ``df``."""
    found = _classified(df, id, text, shingle, bits)
    i, h = fresh_names(df, "id", "hash")
    first = F.min_by(F.struct("id", "text_hash"), F.struct(F.col("id").isNull(), "id", "text_hash"))
    stay = found.groupBy("component").agg(first.alias("s"))
    stay = reliable_checkpoint(stay.select(F.col("s.id").alias(i), F.col("s.text_hash").alias(h)).distinct())
    keyed = df.withColumn(h, F.xxhash64(F.col(text)))
    kept = keyed.join(stay, (keyed[h] == stay[h]) & keyed[id].eqNullSafe(stay[i]), "left_semi")
    return kept.dropDuplicates([id, h]).select(*[F.col(f"`{c}`") for c in df.columns])
