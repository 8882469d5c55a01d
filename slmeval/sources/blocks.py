"""Reading records that may cross the borders of input splits.

Spark's text reader cuts files into splits at a separator, which is not always the end of a record: a
quoted CSV field holds line breaks, and a JSON array has no line per item. Whether a separator ends a
record depends on everything before it in the file, but on little of it: the parity of the quotes, or
the depth of the brackets. So

1. every split is summed up by itself (one row a split),
2. a prefix scan over the splits of each file gives the state at the start of each split,
3. every split then cuts its own records; what reaches over its borders are fragments (at most two a
   split), which are put together by file and position.

The pieces of a file between separators are the rows of the text reader, in order inside a split, so
nothing is shuffled but the summaries and the fragments, and a record is in memory but once. The text is
scanned twice, and a third time for the fragments where a file has several splits.

The summaries are joined to the pieces by file and split: broadcast up to ``MAX_BROADCAST`` splits (counted),
else by key, with the pieces sorted again inside their split. All scans must cut the files alike; a
split without a state (settings or files were changed in between) fails the read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint

MAX_BROADCAST = 1_000_000  # splits, about 40 bytes each
RUN_BYTES = 1 << 20  # text taken up at once: its state takes some tens of bytes for each of its own
FILE, START = "_blk_file", "_blk_start"


def pieces(spark: SparkSession, path: str | list[str], separator: str, base: str | None = None) -> DataFrame:
    """(file, split start, partition columns of ``path``, value) of the texts between separators. A file is
    named by the XXH64 of its path."""
    reader = spark.read.option("lineSep", separator)
    if base is not None:
        reader = reader.option("basePath", base)
    rows = reader.text(path)
    parts = [c for c in rows.columns if c != "value"]
    return rows.select(F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(START), *parts, "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """(start, end) of the rows of one split after the other, in runs of about ``RUN_BYTES`` of text."""
    file, start = (batch.column(i).to_numpy() for i in (0, 1))
    if len(file):
        lengths = pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)
        size = np.cumsum(lengths, dtype=np.int64) // RUN_BYTES
        cut = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1]) | (size[1:] != size[:-1])) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(file)])


def summaries(rows: DataFrame, add: Callable, begin: tuple, columns: str) -> DataFrame:
    """One row for each split: ``add(values, summary) -> summary`` over its values, from ``begin``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, done = None, begin, []
        for batch in batches:
            for a, b in _runs(batch):
                here = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if here != key:
                    if key is not None:
                        done.append((*key, *now))
                    key, now = here, begin
                now = add(batch.column(2).slice(a, b - a), now)
        if key is not None:
            done.append((*key, *now))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=schema)

    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in columns.split(", ")]
    schema = pa.schema([(FILE, pa.int64()), (START, pa.int64()), *[(n, types[t]) for n, t in fields]])
    return reliable_checkpoint(rows.select(FILE, START, "value").mapInArrow(run, f"{FILE} bigint, {START} bigint, {columns}"))


def before(column: Column | str) -> Column:
    """The sum of ``column`` over the earlier splits of the file."""
    order = Window.partitionBy(FILE).orderBy(START).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(order), F.lit(0))


def records(rows: DataFrame, states: DataFrame, advance: Callable, separator: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(partition columns, ``extra`` columns of ``states``, first, closed, text) of all records.

    ``states`` are (file, split start, ``s0``, ``s1``, ...): the state at the start of each split, one row each.
    ``advance(values, state) -> (starts, state, closed)`` tells which values start a record, the state
    after them and whether the last one ends a record. ``first``: the record begins its file. A record
    that its file does not end has ``closed`` false.
    """
    spark = rows.sparkSession
    parts = [c for c in rows.columns if c not in (FILE, START, "value")]
    inner = [c for c in states.columns if c not in (FILE, START, *extra)]
    states = reliable_checkpoint(states)
    n = states.agg(F.count("*").alias("n"), F.count_distinct(FILE).alias("files")).first()
    few = n.n <= MAX_BROADCAST
    known = F.col(inner[0]).isNotNull()
    if few:
        told = rows.join(F.broadcast(states), [FILE, START], "left")  # keeps the order of the pieces
    else:
        told = rows.withColumn("_blk_nr", F.monotonically_increasing_id()).join(states, [FILE, START], "left")
        told = told.repartition(FILE, START).sortWithinPartitions(FILE, START, "_blk_nr")
    first_state = F.when(known, F.col(inner[0])).otherwise(F.raise_error(F.lit("the input was split in another way than before")))
    told = told.select(FILE, START, first_state.cast("int").alias(inner[0]), *inner[1:], *parts, *extra, "value")
    keep = [told.schema[c] for c in (*parts, *extra)]
    out = T.StructType([T.StructField(FILE, T.LongType()), T.StructField(START, T.LongType()), *keep,
                        T.StructField("first", T.BooleanType()), T.StructField("began", T.BooleanType()),
                        T.StructField("closed", T.BooleanType()), T.StructField("text", T.StringType())])
    names = [*parts, *extra]
    if n.n == n.files:  # no file has a second split: no fragments
        return told.mapInArrow(_cut(advance, separator, len(inner), None), out).select(*names, "first", "closed", "text")
    whole = told.mapInArrow(_cut(advance, separator, len(inner), False), out)
    loose = reliable_checkpoint(told.mapInArrow(_cut(advance, separator, len(inner), True), out))
    nr = F.sum(F.col("began").cast("int")).over(Window.partitionBy(FILE).orderBy(START, "began"))
    joined = loose.withColumn("nr", nr).groupBy(FILE, "nr").agg(
        *[F.first(c).alias(c) for c in names], F.max("first").alias("first"), F.max("closed").alias("closed"),
        F.sort_array(F.collect_list(F.struct(START, "began", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), separator)
    return whole.select(*names, "first", "closed", "text").union(joined.select(*names, "first", "closed", text.alias("text")))


def _cut(advance: Callable, separator: str, n_state: int, loose: bool | None):
    """Records inside the splits (``loose`` false), the fragments (true) or all (None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held, began, closed, constant, first = None, (), [], False, True, [], False
        for batch in batches:
            out: list[list] = []

            def emit(texts, began, closed):
                nonlocal first
                n, mark = len(texts), first and began and len(texts) > 0
                if mark:
                    first = False
                if n and (loose is None or loose != (began and closed)):
                    marks = np.zeros(n, dtype=bool)
                    marks[0] = mark
                    out.append([*[pa.repeat(c, n) for c in constant], pa.array(marks), pa.repeat(pa.scalar(began), n),
                                pa.repeat(pa.scalar(closed), n), texts])

            for a, b in _runs(batch):
                here = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if here != key:
                    if held:
                        emit(pa.array([separator.join(held)]), began, closed)
                    key, held, began, closed = here, [], False, True
                    state = tuple(batch.column(2 + i)[a].as_py() for i in range(n_state))
                    constant = [batch.column(0)[a], batch.column(1)[a], *[batch.column(i)[a] for i in range(2 + n_state, batch.num_columns - 1)]]
                    first = here[1] == 0
                values = batch.column(batch.num_columns - 1).slice(a, b - a)
                starts, state, closed = advance(values, state)
                at = np.flatnonzero(starts)
                head = int(at[0]) if len(at) else len(values)
                held += values.slice(0, head).to_pylist()
                if not len(at):
                    continue
                if held:
                    emit(pa.array([separator.join(held)]), began, True)
                held, began = [], True
                bounds = np.append(at, len(values))
                if not closed:
                    held, bounds = values.slice(int(at[-1])).to_pylist(), bounds[:-1]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
                emit(pc.binary_join(lists, separator), True, True)
            yield from _batches(out, batch, n_state)
        if held:
            out = []
            emit(pa.array([separator.join(held)]), began, closed)
            yield from _batches(out, batch, n_state)

    def _batches(out: list[list], batch: pa.RecordBatch, n_state: int) -> Iterator[pa.RecordBatch]:
        names = [FILE, START, *batch.schema.names[2 + n_state : -1], "first", "began", "closed", "text"]
        for columns in out:
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
