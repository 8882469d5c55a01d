"""One JSON array of objects, read by many tasks.

The text is cut at every ``}`` (the separator of Spark's text reader), whether or not it ends an item. Each
split reports the parity of its quotes and the change of the bracket depth for both cases, that it
starts inside a string or outside; a prefix scan over the splits of a file picks one and gives the depth at the
start of each split (see :mod:`slmeval.sources.blocks`). An item ends at a ``}`` outside strings that
brings the depth back to 1. No text longer than an item is ever held, whether the array is on one line
or on many.

An escaped character never is the separator, so backslashes need no state between pieces. Anything but
objects, commas and white space between the brackets fails the read, as does an array that is not
closed. An empty file or array has no items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks

_STEP = np.zeros(256, dtype=np.int64)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1
BREAK = "}"


def _structure(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parity of the unescaped quotes up to each byte, depth step of each byte, ends of the values) of the
    values, each with its separator."""
    data = (BREAK.join(values.to_pylist()) + BREAK).encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    lengths = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    place = np.flatnonzero(raw == 34)
    solid = np.maximum.accumulate(np.where(raw != 92, np.arange(len(raw)), -1))  # last byte that is no backslash
    run = np.where(place > 0, place - 1 - solid[np.maximum(place - 1, 0)], 0)
    quote = np.zeros(len(raw), dtype=np.int8)
    quote[place[run % 2 == 0]] = 1
    return np.cumsum(quote, dtype=np.int64) & 1, _STEP[raw], ends


def _add(values: pa.Array, now: tuple) -> tuple:
    """(parity, depth change if it starts outside a string, if inside) of a split."""
    parity, outside, inside = now
    inner, step, _ = _structure(values)
    change = [int(step[inner == 0].sum()), int(step[inner == 1].sum())]
    return parity ^ int(inner[-1]), outside + change[parity], inside + change[1 - parity]


def _advance(values: pa.Array, state: tuple) -> tuple:
    string, depth = state
    inner, step, ends = _structure(values)
    inner ^= string
    level = depth + np.cumsum(np.where(inner == 0, step, 0))
    level, quoted = level[ends], inner[ends]
    free = (quoted == 0) & (level <= 1)  # after each value
    before = np.append(string == 0 and depth <= 1, free[:-1])
    return before, (int(quoted[-1]), int(level[-1])), bool(free[-1]) and level[-1] == 1


def read_array_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value) the text of every item of the JSON arrays below ``path``."""
    rows = blocks.pieces(spark, path, BREAK)
    found = blocks.summaries(rows, _add, (0, 0, 0), "parity int, outside bigint, inside bigint")
    string = (blocks.before("parity") % 2).cast("int")
    strings = found.select(blocks.FILE, blocks.START, string.alias("s0"), "outside", "inside")
    change = F.when(F.col("s0") == 0, F.col("outside")).otherwise(F.col("inside"))
    states = strings.select(blocks.FILE, blocks.START, "s0", blocks.before(change).alias("s1"))
    # the separator that ends the last piece is not in the file: a closed array ends at depth -1
    unclosed = strings.groupBy(blocks.FILE).agg(F.sum(change).alias("depth")).filter("depth <> -1").count()
    if unclosed:
        raise ValueError(f"not an array of objects: {unclosed} files end inside one")
    texts = blocks.records(rows, states, _advance, BREAK)
    # the rest of a file after its last item is its closing bracket
    empty = F.col("first") & F.col("text").rlike(r"\A[\x20\t\r\n]*(\[[\x20\t\r\n]*\][\x20\t\r\n]*)?\z")
    rest = ~F.col("first") & F.col("text").rlike(r"\A[\x20\t\r\n]*\][\x20\t\r\n]*\z")
    lead = F.when(F.col("first"), F.lit(r"\A[\x20\t\r\n]*\[[\x20\t\r\n]*\{")).otherwise(F.lit(r"\A[\x20\t\r\n]*,[\x20\t\r\n]*\{"))
    sound = F.when(F.col("closed"), F.regexp(F.col("text"), lead)).otherwise(empty | rest)
    item = F.concat(F.ltrim("text", F.lit("[, \t\r\n")), F.lit(BREAK))
    wrong = F.raise_error(F.concat(F.lit("not an array of objects: "), F.left("text", F.lit(60))))
    checked = texts.withColumn("value", F.when(~sound, wrong.cast("string")).when(F.col("closed"), item))
    return checked.filter("value is not null").select("value")
