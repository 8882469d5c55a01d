"""Session helpers: a local session for tests and the benchmark, and the checkpoint folder.

Library functions never create a session; they take DataFrames. Operators that must cut
lineage (two passes over the same range-partitioned data) use ``checkpoint()`` in the folder
the cluster names in ``spark.checkpoint.dir``; only a local master gets a scratch folder when that
is unset. Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` so that checkpoints go with the
DataFrames that use them.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "slmeval") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SLMEVAL_DRIVER_MEMORY", "8g"))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``slmeval`` importable in Python workers (zip it once and ``addPyFile`` it).

    Arrow map functions defined in this package are pickled by reference, so the workers must
    import the package; on a cluster this is what ``--py-files`` does.
    """
    sc = spark.sparkContext
    key = sc.applicationId  # unique per application, unlike a Python object id
    if key in _shipped:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="slmeval-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(path)
    _shipped.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where it names none, a local master gets a scratch
    folder of its own; on a cluster that is an error, as executors share no local folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.split("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="slmeval-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder for tables an operator writes itself."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{os.getpid()}-{next(_counter)}-{os.urandom(4).hex()}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: fixes partition membership and cuts lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _count():
    n = 0
    while True:
        n += 1
        yield n


_counter = _count()
