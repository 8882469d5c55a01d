"""Q&A item sources: a JSON array file (the reference's format) or JSON lines.

An array file is split among tasks like any text file (:mod:`slmeval.sources.split_json`): no task holds
more than an item of it. Text fields stay text (no numeric inference).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .split_json import read_array_items

ITEM_FIELDS = ("scenario", "question", "answer")


def read_items(
    spark: SparkSession,
    path: str,
    fields: Sequence[str] = ITEM_FIELDS,
    required: Sequence[str] = (),
    multi_line: bool = True,
    id_col: str = "item_id",
) -> DataFrame:
    """Items with an explicit schema and an ``item_id`` made of their content.

    The id is the hex MD5 of the fields' JSON, so it does not depend on the file layout; equal
    items share it (number them with ``number_runs`` where each copy needs its own).

    ``required`` fields must be present: a row without the key fails the job whichever columns are
    selected, as a missing key raises in the reference; a JSON null is a NULL text.
    """
    text = read_array_items(spark, path) if multi_line else spark.read.text(path).filter(F.trim("value") != "")
    # one map per object keeps the difference between a missing key and a null
    objects = text.select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("o"))
    if required:
        missing = F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.map_contains_key("o", r))
        objects = objects.filter(F.when(F.size(missing) > 0, F.raise_error(F.concat(
            F.lit("item without '"), F.array_join(missing, "', '"), F.lit("'")))).otherwise(F.lit(True)).cast("boolean"))
    df = objects.select(*[F.col("o")[f].alias(f) for f in fields])
    key = F.md5(F.to_json(F.struct(*[F.col(f) for f in fields]), {"ignoreNullFields": "false"}))
    return df.select(key.alias(id_col), *fields)


def _brackets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lead = "["
    for batch in batches:
        if batch.num_rows:
            signs = pa.array([lead] + [","] * (batch.num_rows - 1))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(signs, batch.column(0), "")], names=["value"])
            lead = ","
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], names=["value"])


def write_items(df: DataFrame, path: str) -> None:
    """Each partition of ``df`` as a file with one JSON array, a line for each item; all columns, nulls too."""
    item = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    df.select(item.alias("value")).mapInArrow(_brackets, "value string").write.text(path)
