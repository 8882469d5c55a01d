"""How the driver tables stand in for the reference's data.

The reference's inputs (Q&A item JSON, run-result CSVs, ``/proc/stat`` and ``free -m``
readings, trainer logs) are not shipped, so the registered queries read the driver's
parquet tables through these mappings. Every mapping is a projection or a Spark-derived
table over the whole input table.

* runs     <- ``lineitem``: label = l_returnflag, inference_time = l_quantity,
              ram_after = l_extendedprice, cpu_usage = l_tax, ram_before = l_discount * 1000
* items    <- ``conversations``: scenario = role, question = text
* training <- ``conversations``: every user turn; answer = the text of the assistant turn at
              ``turn + 1`` (NULL without one)
* answers  <- ``documents.text`` (generated text to clean, split and encode)
* counters <- ``events``: per user (device) running sums of value cents; idle = 'view' cents
* memory   <- ``events``: total 8191 MB, available = floor(value * 10) MB
* logs     <- ``events``: click -> {loss}, view -> {eval_loss}, purchase -> both, signup -> {},
              error -> NULL
* vectors  <- ``embeddings.embedding``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from ..session import reliable_checkpoint

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Fixed values of the fixture mapping.
MEMORY_TOTAL_MB = 8191
RUN_LABEL_ORDER = ["A", "N", "R"]
# The input order of runs: these lineitem columns identify a row.
RUN_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table (one file listing and footer read per session and path)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = _TABLES[key] = spark.read.parquet(path)
    return df


def runs_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *RUN_ORDER,
        F.col("l_returnflag").alias("label"),
        F.concat(F.lit("status "), F.col("l_linestatus")).alias("answer"),
        (F.col("l_discount") * F.lit(1000.0)).alias("ram_before"),
        F.col("l_extendedprice").alias("ram_after"),
        F.col("l_tax").alias("cpu_usage"),
        F.col("l_quantity").alias("inference_time"),
    )


def items_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("role").alias("scenario"), F.col("text").alias("question"))


def training_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns; the answer is the text of an assistant turn at ``turn + 1``, NULL without one.

    An equi-join on ``(conv_id, turn)`` hashes on both keys, so one long conversation is still
    spread over many tasks (a ``lead`` window would put it into one).
    """
    c = table(spark, sf_dir, "conversations")
    q = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("role").alias("scenario"),
                                                   F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"], "left")


def counters_from_events(spark: SparkSession, sf_dir: str, num_partitions: int | None = None) -> DataFrame:
    """``(device_id, ts, event_id, counters ARRAY<BIGINT>)``: cumulative CPU counters per device.

    counters = [busy, 0, 0, idle] where busy / idle are running sums of value cents of
    non-'view' / 'view' events in ``(ts, event_id)`` order, so idle is ``counters[3]`` and the
    total is the sum of all elements, as for the first ``/proc/stat`` line without ``cpu``.
    """
    ev = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    base = ev.select(
        F.col("user_id").alias("device_id"), "ts", "event_id",
        F.when(F.col("event_type") == "view", F.lit(0)).otherwise(cents).alias("_busy"),
        F.when(F.col("event_type") == "view", cents).otherwise(F.lit(0)).alias("_idle"),
    )
    s = ordered_scan(base, ["device_id"], ["ts", "event_id"], weight={"_busy_before": F.col("_busy"), "_idle_before": F.col("_idle")},
                     num_partitions=num_partitions)
    busy = F.col("_busy_before") + F.col("_busy")
    idle = F.col("_idle_before") + F.col("_idle")
    zero = F.lit(0).cast("long")
    snaps = s.select("device_id", "ts", "event_id", F.array(busy, zero, zero, idle).alias("counters"))
    return reliable_checkpoint(snaps)  # a Python scan that the next scan would run twice


def memory_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.col("user_id").alias("device_id"),
        "ts",
        F.lit(MEMORY_TOTAL_MB).cast("long").alias("total_mb"),
        F.floor(F.col("value") * 10).cast("long").alias("available_mb"),
    )


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, seq, logs MAP<STRING,DOUBLE>)`` trainer log records."""
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    logs = (
        F.when(F.col("event_type") == "click", F.create_map(F.lit("loss"), v))
        .when(F.col("event_type") == "view", F.create_map(F.lit("eval_loss"), v))
        .when(F.col("event_type") == "purchase", F.create_map(F.lit("loss"), v, F.lit("eval_loss"), v / 2))
        .when(F.col("event_type") == "signup", F.create_map().cast("map<string,double>"))
    )
    return ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), logs.alias("logs"))
