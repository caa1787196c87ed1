"""Progressive loading as Structured Streaming.

The stream reads the dataset's own Parquet files, about one shard's files per
trigger, and can go on: given the same ``state`` folder, a later call takes the
files that have arrived since, and only those.

* T1 and T4 append rows through the Parquet file sink, whose log names the
  files of every committed epoch: a reader of the folder sees committed rows
  once each, whatever a killed attempt has left there.
* T2 and T3 keep Spark's streaming state (counts per value; count, ranges and
  extents per shard) in the checkpoint. Each epoch writes the changed keys to
  a folder of its own, which a retry overwrites, and readers take the epochs
  that the checkpoint has committed.

State, sinks and checkpoints lie in the shared folder or where the caller
says; no row passes through the driver and no session setting is touched. Set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider where
the domains outgrow executor memory (``get_session`` does).

``arrivals`` runs a function on each shard in order, told by arrival notices.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudsift.operators.filters import FilterSpec, compile_filters
from cloudsift.operators.profile import attribute_domain, clean_number
from cloudsift.roles import Roles
from cloudsift.session import shared_dir
from cloudsift.sources.shards import shard_files


def post_notices(spark: SparkSession, folder: str, shards: list[int]) -> None:
    """One notice per shard; modification times follow the order given, since
    the file source takes the oldest first."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for i, k in enumerate(shards):
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{i:06d}.json")
        fs = p.getFileSystem(conf)
        out = fs.create(p, True)
        try:
            out.write(bytearray(f'{{"shard": {k}}}\n'.encode()))
        finally:
            out.close()
        fs.setTimes(p, 1_000_000_000_000 + 1000 * i, -1)


def arrivals(spark: SparkSession, path: str, out: str, each: Callable[[DataFrame, int], DataFrame],
             start: int = 0, stop: int | None = None) -> list[int]:
    """Run ``each(rows of the shard, shard)`` for the shards start+1 .. stop in
    order, one per trigger, writing every result below ``out/epoch=N``.
    Returns the shards in order of arrival."""
    data = spark.read.parquet(path)
    if stop is None:
        stop = data.agg(F.max("shard")).first()[0] or 0          # shards are 1..n
    notices, ckpt = shared_dir(spark, "notices"), shared_dir(spark, "arrivals-ckpt")
    shards = list(range(start + 1, stop + 1))
    if not shards:
        return []
    post_notices(spark, notices, shards)
    seen: list[int] = []

    def take(batch: DataFrame, epoch: int) -> None:
        for row in batch.select("shard").collect():               # one notice
            seen.append(row.shard)
            each(data.where(F.col("shard") == row.shard), row.shard).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (spark.readStream.schema("shard int").option("maxFilesPerTrigger", 1).json(notices)
         .writeStream.foreachBatch(take).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return seen


def _arriving(spark: SparkSession, path: str) -> DataFrame:
    """The dataset as a stream of its files, about a shard's files a trigger."""
    files = shard_files(spark, path)
    per_trigger = max(1, math.ceil(sum(files.values()) / max(1, len(files))))
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _appended(spark: SparkSession, rows: DataFrame, state: str) -> DataFrame:
    """Run the stream over what has arrived, appending to ``state/rows``; the
    committed rows of all runs."""
    (rows.writeStream.format("parquet").option("checkpointLocation", f"{state}/checkpoint").option("path", f"{state}/rows")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(rows.schema).parquet(f"{state}/rows")


def committed_epochs(spark: SparkSession, checkpoint: str) -> int:
    """The last epoch that the query has committed, -1 before the first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return -1
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=-1)


def _updated(spark: SparkSession, state_rows: DataFrame, state: str) -> DataFrame:
    """Run the stateful stream over what has arrived; the changed keys of every
    committed epoch of all runs, with ``epoch``."""
    out, checkpoint = f"{state}/epochs", f"{state}/checkpoint"

    def write(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    (state_rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
     .trigger(availableNow=True).start().awaitTermination())
    last = committed_epochs(spark, checkpoint)
    if last < 0:
        return spark.createDataFrame([], state_rows.schema).withColumn("epoch", F.lit(0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state_rows.schema.fields)
    return spark.read.schema(f"{schema}, epoch int").parquet(out).where(F.col("epoch") <= last)


def progressive_load(spark: SparkSession, path: str, columns: list[str] | None = None, state: str | None = None) -> DataFrame:
    """Every arriving row, appended; the end state is all shards. A call
    with the ``state`` folder of an earlier one goes on from there."""
    rows = _arriving(spark, path)
    return _appended(spark, rows.select(*columns) if columns else rows, state or shared_dir(spark, "t1"))


def progressive_filter(spark: SparkSession, path: str, specs: list[FilterSpec],
                       columns: list[str] | None = None, state: str | None = None) -> DataFrame:
    """T4: the filter list applied to arriving rows (stateless, append)."""
    rows = _arriving(spark, path).where(compile_filters(specs))
    return _appended(spark, rows.select(*columns) if columns else rows, state or shared_dir(spark, "t4"))


def progressive_domain(spark: SparkSession, path: str, roles: Roles, state: str | None = None) -> DataFrame:
    """(attribute, value, n) as shards arrive, counted in streaming state;
    each epoch gives the values whose count has changed, and the last count of
    a value (the largest, they never fall) is its state."""
    changed = _updated(spark, attribute_domain(_arriving(spark, path), roles), state or shared_dir(spark, "t2"))
    return changed.groupBy("attribute", "value").agg(F.max("n").alias("n"))


def progressive_summary(spark: SparkSession, path: str, roles: Roles, axes: tuple[str, str, str] | None = None,
                        state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Row count, range and extents after each shard, whatever the order in
    which files arrive. The state holds them per shard (a row each), so the
    history is a running total over that. Returns (history with one row per
    shard loaded so far, end state: one row, 0 rows and nulls before any)."""
    axes = axes or roles.default_axes
    aggs, mins, maxs = [F.count(F.lit(1)).alias("rows")], [], []
    for name, v in [(c, clean_number(F.col(c))) for c in roles.continuous] + \
            [(n, F.coalesce(F.col(a).cast("double"), F.lit(0.0))) for n, a in zip("xyz", axes)]:
        aggs += [F.min(v).alias(f"min_{name}"), F.max(v).alias(f"max_{name}")]
        mins.append(f"min_{name}")
        maxs.append(f"max_{name}")
    both = [c for pair in zip(mins, maxs) for c in pair]
    run = lambda c: F.min(c) if c in mins else F.max(c)
    changed = _updated(spark, _arriving(spark, path).groupBy("shard").agg(*aggs), state or shared_dir(spark, "t3"))
    steps = changed.groupBy("shard").agg(F.max("rows").alias("rows"), *(run(c).alias(c) for c in both))       # counts and ranges only grow
    so_far = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)                # one row per shard
    history = steps.select("shard", F.sum("rows").over(so_far).cast("bigint").alias("rows"), *(run(c).over(so_far).alias(c) for c in both))
    end = steps.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"), *(run(c).alias(c) for c in both))
    return history, end
