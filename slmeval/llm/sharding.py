"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

1. Slots. A record's slot is the XXH64 of its id and text modulo ``SLOTS``: thousands of slots, far
   more than shards, whose number never changes. Rows equal in id and text share a slot.
2. Loads. Rows and bytes of every slot, one grouped sum (combined on the map side; at most ``SLOTS``
   groups however many rows there are).
3. Map. A table (version, shards, slot, shard). Version 0 deals the slots round. ``rebalance`` makes
   the next version by an edit: every shard keeps its largest slots as long as their bytes stay
   within the mean of all shards; the other slots, largest first, go each to the shard that is
   lightest then. ``rebalance`` with another number of shards grows or shrinks the map: slots of
   shards that are no more move, new shards fill up from those above the new mean. All versions stay
   in the stored table, one folder a version; readers take the newest, or the one they name.
4. Shards. A record's shard is that of its slot: one join with the map, broadcast (``SLOTS`` rows).
   Its place in the shard is its number in (virtual slot, id, text) order, from 0 without gaps, by the
   library's ordered scan: range partitions, so neither a shard nor a slot is one task.

DataFrame functions only; the edit is a window and a fold over the ``SLOTS`` rows of the map and does
not grow with the data. Law ``bytes``: with the largest-first rule the shards differ by less than the
largest slot, and by far less with slots much smaller than a shard.

Results: a null text has no bytes, a record's size is its UTF-8 bytes plus 1; null ids are hashed
like any other value. Repeated rows stay together and take successive places. An empty table gives
an empty result; its map is version 0 edited without loads. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from .common import reliable_checkpoint

SLOTS = 8192
SEED = 13


def with_slots(df: DataFrame, id: str = "doc_id", text: str = "text", slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(id, size, text_crc32, text_hash, virtual_slot) of each row of ``df``."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.select(
        F.col(id).alias("id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.xxhash64(F.col(text)).alias("text_hash"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id), F.xxhash64(F.col(text))), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(records: DataFrame) -> DataFrame:
    """(virtual_slot, rows, bytes) of the slots with records."""
    return records.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: the slots dealt round over the shards."""
    if not 0 < shards <= slots:
        raise ValueError(f"{shards} shards for {slots} slots")
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(0).alias("version"), F.lit(shards).alias("shards"), slot.alias("virtual_slot"),
                                     (slot % shards).alias("shard"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` (one version) for ``shards`` shards, edited by the bytes of ``loads``."""
    every = slot_map.join(F.broadcast(loads.select("virtual_slot", "bytes")), "virtual_slot", "left").select(
        "version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    every = reliable_checkpoint(every)  # one row a slot
    mean = F.sum("bytes").over(Window.partitionBy()) / shards
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    upto = F.sum("bytes").over(largest.rowsBetween(Window.unboundedPreceding, 0))
    stays = (F.col("shard") < shards) & (F.col("upto") <= F.col("mean"))
    marked = every.withColumn("mean", mean).withColumn("upto", upto).withColumn("stays", stays)
    # one row: slots that stay add to the load of their shards, then those that move, largest first
    turn = F.sort_array(F.collect_list(F.struct((~F.col("stays")).alias("moves"), (-F.col("bytes")).alias("less"), "virtual_slot", "shard")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))

    def place(now, slot):
        lightest = F.array_position(now["load"], F.array_min(now["load"])).cast("int") - 1
        to = F.when(slot["moves"], lightest).otherwise(slot["shard"])
        load = F.transform(now["load"], lambda b, s: F.when(s == to, b - slot["less"]).otherwise(b))
        return F.struct(load.alias("load"), F.concat(now["to"], F.array(to)).alias("to"))

    moved = marked.agg(turn.alias("turn")).select("turn", F.aggregate("turn", start, place, lambda now: now["to"]).alias("to"))
    moved = moved.select(F.explode(F.arrays_zip("turn", "to")).alias("m")).select(
        F.col("m.turn.virtual_slot").alias("virtual_slot"), F.col("m.to").alias("to"))
    edited = every.join(F.broadcast(moved), "virtual_slot")
    return reliable_checkpoint(edited.select(
        (F.col("version") + 1).alias("version"), F.lit(shards).alias("shards"), "virtual_slot", F.col("to").alias("shard")))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored table: a folder of its own, so a version is there whole or not at all."""
    version = slot_map.select("version").first()[0]
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The named version of the stored table, or the newest."""
    versions = spark.read.schema("shards int, virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == version).select("version", "shards", "virtual_slot", "shard")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Append ``shard``, ``map_version`` and ``slot`` (place in the shard, from 0) to the rows of ``with_slots``."""
    where = F.broadcast(slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version")))
    placed = records.join(where, "virtual_slot")
    return ordered_scan(placed, ["shard"], ["virtual_slot", "id", "text_hash"], cum_col="slot")


def shard_documents(df: DataFrame, path: str, shards: int = 16, id: str = "doc_id", text: str = "text",
                    slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, text_hash, virtual_slot, shard, map_version, slot) of each row of ``df``, after one
    edit of the map by the loads of ``df``. ``path`` holds the stored versions; without any, version 0
    is stored first."""
    spark = df.sparkSession
    records = reliable_checkpoint(with_slots(df, id, text, slots))
    try:
        now = load_map(spark, path)
    except Exception as e:  # no such folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        store_map(first_map(spark, shards, slots), path)
        now = load_map(spark, path)
    store_map(rebalance(now, slot_loads(records), shards), path)
    return assign(records, load_map(spark, path))
