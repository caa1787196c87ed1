"""Session construction and the shared scratch location.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names; we
only pick our own (under the system temp dir) when the session has none and
the master is local, as in tests.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"

# Largest table we hint for broadcast after measuring it: palettes, value sets
# and dimension tables; larger ones shuffle-join.
BROADCAST_MAX_ROWS = 250_000
BROADCAST_MAX_BYTES = 16 << 20

# Bytes after which a batch of rows for a Python worker ends. Spark's own limit
# is 64 MB; a batch lies in the JVM's memory, twice while it grows, and twice in
# the worker's, which reads the next while it works on one.
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARK_BATCH = 64 << 20
BATCH_BYTES = 4 << 20


def cluster_conf(input_bytes: float, cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized to the data: enough shuffle partitions that each holds
    about ``partition_bytes`` (AQE coalesces small ones at run time and splits
    skewed ones), scan splits of the same size."""
    parts = max(cores * 2, int(input_bytes // partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "cloudsift", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_root: dict[str, str] = {}
_made: list[tuple[str, str]] = []     # (application id, folder) of shared_dir


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share: the context's checkpoint folder if one
    is set (Spark sets it from ``spark.checkpoint.dir``, or the user through
    ``setCheckpointDir``), else the session's ``spark.checkpoint.dir``. With
    neither, a local master gets a temporary folder; a cluster raises, since a
    machine-local folder would lose data there."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if not root:
        root = spark.conf.get(_CHECKPOINT_KEY, None)
        if not root:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = _local_root.setdefault(sc.applicationId, "")
            if not root:
                root = _local_root[sc.applicationId] = tempfile.mkdtemp(prefix="cloudsift-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below the shared checkpoint root, made
    through Hadoop's file system. It is deleted when the driver ends, or
    earlier by ``release``."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    p, fs = _fs(spark, path)
    if not fs.mkdirs(p):
        raise OSError(f"cannot create {path}")
    _made.append((spark.sparkContext.applicationId, path))
    return path


def release(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``shared_dir`` whose data nobody reads any more."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)
    _made[:] = [m for m in _made if m[1] != path]


@atexit.register
def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or not _made:
        return
    try:
        app = spark.sparkContext.applicationId
        for owner, path in list(_made):
            if owner == app:
                release(spark, path)
    except Exception:  # the JVM is already gone: nothing left to ask
        return


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: later
    jobs reuse it, its lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark, name)}/data"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_whole(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``df`` staged once, with a broadcast hint when it has at most
    ``max_rows`` rows and ``max_bytes`` bytes of text and fixed-width values;
    above that as it is (a shuffle join)."""
    t = staged(df, "small")
    wide = F.lit(0)
    for f in t.schema.fields:
        wide = wide + (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(8))
    size = t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(wide), F.lit(0)).alias("b")).first()
    return F.broadcast(t) if size.n <= max_rows and size.b <= max_bytes else t


def bound_batches(spark: SparkSession) -> None:
    """Batches of about ``BATCH_BYTES`` for Python workers, unless the session
    has a limit of its own. The rows are the same, in more batches; a batch
    ends with the row that passes the limit."""
    if spark.conf.get(_BATCH_KEY) == f"{_SPARK_BATCH}b":
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


def show_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the
    driver has it. On a cluster, install it there or pass it as --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
