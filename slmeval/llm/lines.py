"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact Jaccard, union-find.

Lines are the ``\\n``-separated parts of a text that hold a word; equal lines are one node, named by
the XXH64 of the line. Two lines are linked when the Jaccard similarity of their sets of
``SHINGLE``-character shingles (a shorter line is one shingle) is at least ``THRESHOLD``. One line
of each component is kept: the first by document id and line number.

1. Signature: one-permutation MinHash with optimal densification, ``BANDS * ROWS`` values, in numpy
   over all lines of a batch. A pair at the threshold shares a band with probability
   1 - (1 - 0.8^4)^12 > 0.998, a pair at 0.9 with more than 0.99999.
2. Candidates: lines with a common band. A band's lines are compared with its smallest line, so a
   band gives as many pairs as lines. Keys that would hold very many lines are found in a sample
   of documents and salted; the sample only places the salt and has no influence on the result.
3. Verification: exact Jaccard of the two texts of every candidate pair.
4. Components by distributed union-find. Bands whose lines still lie in more than one component
   are searched for links between those components: the lines of a band are compared by one task in
   blocks of about ``BLOCK`` (intersections of all pairs by one matrix product over the shingles that
   lines of the block share), which writes only links that join two components. For bands of several
   blocks, the lines outside the band's largest component are then compared with every block.

Only (band, line) rows, the lines that share a band, and linear numbers of pairs are shuffled; the
result is brought back to the documents by one join on the document.

Results: null text has no lines. A line repeated in a document or across documents counts once; its
first occurrence is kept. Rows equal in id and text are one document (their lines are kept or
dropped alike). Null ids come last in the order. Lines without a word are kept and never compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ragged
from .common import HAS_WORD, SPACES, fresh_names, partitions, reliable_checkpoint, slices_by_size
from .components import connected_components

SHINGLE = 8
BANDS, ROWS = 12, 4
THRESHOLD = 0.8
SLICE_CHARS = 400_000  # arrays of a slice stay in the processor caches
SEEN = 200_000  # lines a task remembers so as not to sign a copy again
HOT_SAMPLE, HOT_COUNT, SALTS = 64, 64, 64
BLOCK = 256
FEW = 12  # lines that are compared without matrices
COLUMNS = 4096
MAX_BROADCAST = 1_000_000  # line ids, 8 bytes each

_BASE = np.uint64(0x5851F42D4C957F2D)
_EMPTY = np.uint32(2**32 - 1)
_rng = np.random.RandomState(5)
_FILL = np.stack([_rng.permutation([j for j in range(BANDS * ROWS) if j != i]) for i in range(BANDS * ROWS)])
_MIX = (_rng.randint(1, 2**62, BANDS * ROWS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A polynomial of each ``size`` neighbouring codes: halves are joined as long as the size is even."""
    if size == 1:
        return codes
    if size % 2:
        rest = _windows(codes, size - 1)
        return rest[:-1] * _BASE + codes[size - 1 :] if len(rest) else rest
    half = _windows(codes, size // 2)
    factor = np.uint64(pow(int(_BASE), size // 2 * size, 1 << 64))  # another one for each size
    return half[: -(size // 2)] * factor + half[size // 2 :] if len(half) else half


def shingle_hashes(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the shingles of all lines, number of shingles of each line)."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    counts = np.maximum(lengths - size + 1, 1)
    inner = (codes + np.uint32(1)) * np.uint64(0xD6E8FEB86659FD93)
    # a window is left out where it reaches over the end of its line; a short line is one window of its own
    whole = np.ones(max(len(codes) - size + 1, 0), dtype=bool)
    ends = np.cumsum(lengths)
    for k in range(1, size):
        at = ends - k
        whole[at[(at >= 0) & (at < len(whole))]] = False
    h = _windows(inner, size)[whole] if len(whole) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero(lengths < size)
    if len(short):
        padded = np.zeros((len(short), size), dtype=np.uint64)
        own = lengths[short]
        row = np.repeat(np.arange(len(short)), own)
        padded[row, ragged(np.zeros(len(short), dtype=np.int64), own)] = inner[ragged(ends[short] - own, own)]
        single = _windows(padded.ravel(), size)[::size]
        place = np.cumsum(counts)[short] - 1 - np.arange(len(short))
        h = np.insert(h, place, single)
    return _scramble(h), counts


def band_keys(lines: list[str]) -> np.ndarray:
    """BANDS keys (int64) of each line."""
    h, counts = shingle_hashes(lines)
    m = BANDS * ROWS
    cell = np.repeat(np.arange(len(lines)) * m, counts) + (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
    table = np.full(len(lines) * m, _EMPTY, dtype=np.uint32)
    np.minimum.at(table, cell, h.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    filled = table != _EMPTY
    todo, step = np.flatnonzero(~filled), 0
    source = table.copy()
    while len(todo):  # an empty bin takes the value of the first filled one in its own order
        row = todo - todo % m
        other = row + _FILL[todo % m, step]
        ok = filled[other]
        source[todo[ok]] = table[other[ok]]
        todo, step = todo[~ok], step + 1
    mixed = _scramble((source.reshape(-1, m).astype(np.uint64) + np.uint64(1)) * _MIX)
    keys = mixed.reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    return _scramble(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line BIGINT, text) -> (line, keys) once for each line a task has not just seen."""
    seen: set[int] = set()
    for batch in batches:
        ids, texts = [], []
        if len(seen) > SEEN:
            seen.clear()
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            if i not in seen:
                seen.add(i)
                ids.append(i)
                texts.append(t.as_py())
        for a, b in slices_by_size(texts, SLICE_CHARS):
            keys = band_keys(texts[a:b]).ravel()
            offsets = pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a:b], type=pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys))], names=["line", "keys"])


@lru_cache(maxsize=64)  # pairs come sorted by their second line
def _shingles(text: str, size: int) -> frozenset[str]:
    return frozenset(text[i : i + size] for i in range(max(1, len(text) - size + 1)))


def jaccard(a: str, b: str, size: int = SHINGLE) -> float:
    x, y = _shingles(a, size), _shingles(b, size)
    shared = len(x & y)
    return shared / (len(x) + len(y) - shared)


def _distinct(lines: list[str], bits: int) -> np.ndarray:
    """Sorted distinct keys of (row, shingle): the row in the upper ``bits``, a hash below."""
    h, counts = shingle_hashes(lines)
    row = np.repeat(np.arange(len(lines), dtype=np.uint64), counts)
    keys = np.sort((row << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    return keys[np.append(True, keys[1:] != keys[:-1])]


def jaccards(left: list[str], right: list[str]) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each pair, by hashes of the shingles (50 bits or more in a slice)."""
    n = len(left)
    bits = max(1, (n - 1).bit_length())
    x, y = _distinct(left, bits), _distinct(right, bits)
    both = np.sort(np.concatenate([x, y]))
    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(64 - bits)).astype(np.int64), minlength=n)
    sizes = np.bincount((both >> np.uint64(64 - bits)).astype(np.int64), minlength=n)
    return shared / (sizes - shared)


def _similar(a: Column, b: Column, threshold: float) -> Column:
    @F.arrow_udf("boolean")
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            left, right, found = left.to_pylist(), right.to_pylist(), []
            for i, j in slices_by_size([x + y for x, y in zip(left, right)], SLICE_CHARS):
                found.append(jaccards(left[i:j], right[i:j]) >= threshold)
            yield pa.array(np.concatenate(found) if found else [], type=pa.bool_())

    return similar(a, b)


def _overlaps(lines: list[str], threshold: float) -> np.ndarray:
    """Matrix of pairs with a Jaccard similarity of at least the threshold."""
    h, counts = shingle_hashes(lines)
    number, distinct = pd.factorize(h)
    pairs = np.sort(number * len(lines) + np.repeat(np.arange(len(lines)), counts))  # by shingle, then line
    column, row = np.divmod(pairs[np.append(True, pairs[1:] != pairs[:-1])], len(lines))
    sizes = np.bincount(row, minlength=len(lines))
    shared = np.bincount(column, minlength=len(distinct)) > 1  # others are in no intersection
    inner = shared[column]
    row, column = row[inner], (np.cumsum(shared) - 1)[column[inner]]
    common = np.zeros((len(lines), len(lines)), dtype=np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        x = np.zeros((len(lines), COLUMNS), dtype=np.float32)
        x[row[a:b], column[a:b] - start] = 1
        common += x @ x.T
    return common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6


def _joining(component: np.ndarray, line: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Links (by index) that join components, a spanning forest of them."""
    parent: dict[int, int] = {}

    def find(c: int) -> int:
        while c in parent:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near & (component[:, None] != component[None, :]), 1)))):
        a, b = find(int(component[i])), find(int(component[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(line[i]), int(line[j])))
    return out


def _link_blocks(threshold: float):
    """Rows sorted by (key, salt, probe): key, salt, line, component, probe, text -> links (a, b) between
    components, of a block's own lines and of its own lines with its probes."""

    def links(own: list[tuple], probes: list[tuple]) -> list[tuple[int, int]]:
        rows = own + probes
        component = np.array([r[1] for r in rows], dtype=np.int64)
        if (component == component[0]).all():
            return []
        if len(rows) <= FEW and not probes:
            near = np.zeros((len(rows), len(rows)), dtype=bool)
            for i, x in enumerate(rows):
                near[i, [j for j in range(i) if rows[j][1] != x[1] and jaccard(rows[j][2], x[2]) >= threshold]] = True
            return _joining(component, np.array([r[0] for r in rows], dtype=np.int64), near.T)
        near = _overlaps([r[2] for r in rows], threshold)
        if probes:  # own lines were compared with one another before
            near[: len(own), : len(own)] = False
        return _joining(component, np.array([r[0] for r in rows], dtype=np.int64), near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, probes, out, any_probe = None, [], [], [], False

        def close() -> None:
            if own and (probes or not any_probe):
                out.extend(links(own, probes))

        for batch in batches:
            for key, salt, line, component, probe, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if block != (key, salt):
                    close()
                    block, own, probes, any_probe = (key, salt), [], [], False
                if probe:
                    any_probe = True
                    probes.append((line, component, text))
                    if len(probes) == BLOCK:
                        close()
                        probes = []
                else:
                    own.append((line, component, text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], type=pa.int64()), pa.array([x[1] for x in out], type=pa.int64())], names=["a", "b"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], type=pa.int64()), pa.array([x[1] for x in out], type=pa.int64())], names=["a", "b"])

    return run


def _exploded(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, text_hash, line_no, line, text) of every line with a word."""
    rows = df.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"),
                     F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "text"))
    return rows.filter(F.length(F.btrim("text", F.lit(SPACES))) > 0).withColumn("line", F.xxhash64("text"))


def _bands(lines: DataFrame) -> DataFrame:
    return lines.select("line", "text").mapInArrow(_sign, "line bigint, keys array<bigint>").select(
        "line", F.explode("keys").alias("key"))


def _shared_bands(df: DataFrame, id: str, text: str) -> DataFrame:
    """(key, line, rep) of the lines of every band with two or more; ``rep`` is its smallest."""
    part = df.filter(F.pmod(F.xxhash64(F.col(id), F.length(F.col(text))), F.lit(HOT_SAMPLE)) == 0)
    hot = reliable_checkpoint(_bands(_exploded(part, id, text)).groupBy("key").count().filter(F.col("count") >= HOT_COUNT).select("key"))
    bands = _bands(_exploded(df, id, text))
    any_hot = not hot.isEmpty()
    if any_hot:
        few = hot.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        marked = (F.broadcast(hot) if few else hot).withColumn("hot", F.lit(True))
        bands = bands.join(marked, "key", "left").withColumn(
            "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("line"), F.lit(SALTS))).otherwise(0).cast("int"))
    else:
        bands = bands.withColumn("hot", F.lit(None).cast("boolean")).withColumn("salt", F.lit(0))
    band = Window.partitionBy("key", "salt")
    shared = bands.select("key", "hot", "line", F.min("line").over(band).alias("rep"), F.max("line").over(band).alias("last"))
    shared = reliable_checkpoint(shared.filter("rep <> last or hot").select("key", "hot", "line", "rep").distinct())
    if not any_hot:
        return shared.select("key", "line", "rep")
    whole = shared.filter("hot").groupBy("key").agg(F.min("rep").alias("whole"))
    return shared.join(whole, "key", "left").select("key", "line", F.coalesce("whole", "rep").alias("rep"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    left = texts.select(F.col("line").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("line").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(_similar(F.col("text_a"), F.col("text_b"), threshold)).select("a", "b")


def line_components(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(line, component) of the lines that are linked to another one; ``line`` is the XXH64 of the line."""
    shared = reliable_checkpoint(_shared_bands(df, id, text))
    needed = reliable_checkpoint(shared.select("line").distinct())
    few = needed.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    found = _exploded(df, id, text).select("line", "text").join(F.broadcast(needed) if few else needed, "line", "left_semi")
    texts = reliable_checkpoint(found.groupBy("line").agg(F.first("text").alias("text")))
    compared = reliable_checkpoint(shared.filter("line <> rep").select(F.col("line").alias("a"), F.col("rep").alias("b")).distinct())
    links = reliable_checkpoint(_verified(compared, texts, threshold))
    members, classes = shared.select("key", "line"), reliable_checkpoint(connected_components(links))
    for probing in (False, True):
        more = _links_between(members, classes, texts, threshold, probing)
        if more is not None:  # goes on from the components found: each is a star around its smallest line
            stars = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
            classes = reliable_checkpoint(connected_components(stars.union(more)))
    return classes


def _links_between(members: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float, probing: bool) -> DataFrame | None:
    """Links between components of the lines of a band: inside its blocks, or (``probing``) of the lines
    outside its largest component with all its blocks, for bands of several blocks."""
    labelled = reliable_checkpoint(members.join(classes.withColumnRenamed("node", "line"), "line", "left").select(
        "key", "line", F.coalesce("component", "line").alias("component")))
    # bands with the same lines are one; a pair was compared before
    bands = labelled.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("line")).alias("x"), F.sum(F.xxhash64("line") % (1 << 40)).alias("y"))
    open_ = bands.filter((F.col("low") != F.col("high")) & (F.col("n") > (BLOCK if probing else 2)))
    open_ = open_.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select(
        "key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    open_ = reliable_checkpoint(open_)
    if open_.isEmpty():
        return None
    rows = reliable_checkpoint(labelled.join(open_, "key").withColumn("salt", F.pmod(F.xxhash64("line"), F.col("blocks"))))
    own = rows.select("key", "salt", "line", "component", F.lit(0).alias("probe"))
    if probing:
        sizes = rows.groupBy("key", "component").agg(F.count("*").alias("size"))
        main = reliable_checkpoint(sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main")))
        probes = rows.join(main, "key").filter("component <> main").select(
            "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"), "line", "component", F.lit(1).alias("probe"))
        own = own.union(probes)
    dealt = own.join(texts, "line").select("key", "salt", "line", "component", "probe", "text").repartition(
        partitions(members.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", "probe")
    return dealt.mapInArrow(_link_blocks(threshold), "a bigint, b bigint").distinct()


def line_classes(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, text_hash, line_no, first_id, first_line_no, kept) of every line with a word: the first
    occurrence of its class, and whether it is that one."""
    classes = reliable_checkpoint(line_components(df, id, text, threshold).withColumnRenamed("node", "line"))
    few = classes.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    lines = _exploded(df, id, text).select("id", "text_hash", "line_no", "line")
    lines = lines.join(F.broadcast(classes) if few else classes, "line", "left").select(
        "id", "text_hash", "line_no", F.coalesce("component", "line").alias("class"))
    lines = reliable_checkpoint(lines)
    place = F.struct(F.col("id").isNull(), F.col("id"), F.col("text_hash"), F.col("line_no"))
    first = lines.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = lines.join(reliable_checkpoint(first), "class", "left")
    own = F.col("first").isNull() | (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.text_hash") == F.col("text_hash"))
                                     & (F.col("first.line_no") == F.col("line_no")))
    return joined.select("id", "text_hash", "line_no", F.when(own, F.col("id")).otherwise(F.col("first.id")).alias("first_id"),
                         F.when(own, F.col("line_no")).otherwise(F.col("first.line_no")).alias("first_line_no"), own.alias("kept"))


def drop_duplicate_lines(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                         n_chars: str = "n_chars") -> DataFrame:
    """``df`` without the lines that are not kept, and without the documents that lose all their lines
    that hold a word. ``n_chars``, if there is such a column, follows the text."""
    i, h, gone, lines = fresh_names(df, "id", "hash", "gone", "lines")
    drops = line_classes(df, id, text, threshold).filter("not kept").groupBy(
        F.col("id").alias(i), F.col("text_hash").alias(h)).agg(F.collect_set("line_no").alias(gone))
    drops = reliable_checkpoint(drops)
    keyed = df.withColumn(h, F.xxhash64(F.col(text)))
    joined = keyed.join(drops, (keyed[h] == drops[h]) & keyed[id].eqNullSafe(drops[i]), "left").drop(drops[h])
    # positions that stay by one hash set, so the work is linear in the lines of a text
    split = F.split(F.col(text), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    kept = F.transform(stay, lambda k: F.get(split, k))
    joined = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), kept))
    joined = joined.filter(F.col(gone).isNull() | F.exists(lines, lambda x: x.rlike(HAS_WORD)))
    now = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))
    joined = joined.withColumn(lines, now)
    out = []
    for c in df.columns:
        if c == text:
            out.append(F.col(lines).alias(c))
        elif c == n_chars:
            out.append(F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(lines)).cast(df.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)
