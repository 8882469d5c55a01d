"""Image frames as binary rows (``path, modificationTime, length, content``), batch or stream.

Frames are small files, and listing and opening one each is what a scan of them costs. ``pack_frames``
writes them as Parquet rows, in files that follow the bytes of the frames, not their number;
``read_packed_frames`` reads those as a batch (the times and lengths without the contents, if no more
is asked for) or as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("modificationTime", T.TimestampType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("content", T.BinaryType(), True),
    ]
)


def read_frames(spark: SparkSession, path: str, glob: str | None = None, stream: bool = False, **options) -> DataFrame:
    """``binaryFile`` rows; a stream needs the explicit schema."""
    reader = (spark.readStream.schema(FRAME_SCHEMA) if stream else spark.read).format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.options(**options).load(path)


def write_frames(contents: DataFrame, path: str) -> None:
    """Write each row's ``content`` (binary) as a file of its own, with a NUL after it, in a folder
    ``task=<partition>`` of ``path``.

    The files are numbered in the order of the partition, so a task that runs again writes the same files if
    that order is fixed: sort the partitions. They go through Arrow's file system of the path, as Spark's
    writers start processes for each small file on a local disk without Hadoop's native library; where
    Arrow has none, Spark writes them as text, so the contents must be UTF-8 there.
    """
    bare = contents.select("content")
    try:
        FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        text = bare.select(F.col("content").cast("string").alias("value"), F.spark_partition_id().alias("task"))
        text.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).partitionBy("task").text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = FileSystem.from_uri(path)
        folder, n = f"{base}/task={TaskContext.get().partitionId()}", 0
        for batch in batches:
            if not n and batch.num_rows:
                files.create_dir(folder)
            for content in batch.column(0):
                with files.open_output_stream(f"{folder}/frame-{n:09d}") as f:
                    f.write((content.as_py() or b"") + b"\x00")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int64())], names=["n"])

    bare.mapInArrow(write, "n bigint").agg(F.sum("n")).first()


# A packed file holds about as many bytes of frames.
FILE_BYTES = 256 << 20


def pack_frames(frames: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write frames (the columns of ``FRAME_SCHEMA``; others are left out) as packed files at ``path``.

    The number of files is the sum of the lengths over ``file_bytes``. Frames keep no order. A NULL
    length counts as none.
    """
    names = FRAME_SCHEMA.names
    total = frames.agg(F.sum("length")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    frames.select(*names).repartition(files).write.parquet(path)


def read_packed_frames(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """The frames of packed files; bound a stream's micro-batches by ``maxBytesPerTrigger`` or
    ``maxFilesPerTrigger``."""
    reader = (spark.readStream if stream else spark.read).schema(FRAME_SCHEMA)
    return reader.options(**options).parquet(path)
