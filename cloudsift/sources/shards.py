"""Sharded Parquet datasets.

A dataset is one Parquet folder partitioned by ``shard`` (1..n). Each shard
is a uniform random 1/n of the rows; reading shards 1..k is a k/n sample and
prefixes nest (10 % ⊂ 20 %). Reading k shards is partition pruning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudsift.functions.text import reduction_percent

ROWS_PER_GROUP = 500_000  # fixed value: parquet row group rows
ZSTD_LEVEL = 9
SHARD_LIMIT_BYTES = 100e6  # fixed value: warning limit per shard file
ROWS_PER_FILE = 2_000_000


def write_shards(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE,
                 n_rows: int | None = None, repartition: bool = False) -> str:
    """S3 (+S4: overwrite replaces the dataset, never its siblings).

    By default no extra shuffle: after W1 each task holds whole runs of
    consecutive md5 buckets, i.e. contiguous row_idx ranges of about 2M rows,
    so each task writes one sorted file per shard it touches (usually one),
    and row-group statistics on row_idx prune range predicates (a local sort
    by (shard, row_idx) is the writer's required order).
    ``repartition=True`` range-partitions on row_idx first (for inputs whose
    partitioning is unknown). zstd level 9, dictionary, statistics, at most
    500 000 rows per row group and ``rows_per_file`` rows per file. No rows
    give one empty file in the last shard, so that the dataset keeps its
    columns and every reader gives an empty table."""
    out = df
    if repartition:
        if n_rows is None:
            n_rows = df.count()
        out = out.repartitionByRange(max(1, math.ceil(n_rows / rows_per_file)), "row_idx")
    out = out.sortWithinPartitions("shard", "row_idx")
    (out.write.mode("overwrite").partitionBy("shard")
     .option("compression", "zstd")
     .option("parquet.compression.codec.zstd.level", str(ZSTD_LEVEL))
     .option("parquet.enable.dictionary", "true")
     .option("parquet.block.row.count.limit", str(ROWS_PER_GROUP))
     .option("maxRecordsPerFile", rows_per_file)
     .parquet(path))
    if not shard_files(df.sparkSession, path):
        df.limit(0).drop("shard").coalesce(1).write.parquet(f"{path}/shard={EMPTY_SHARD}")
    return path


EMPTY_SHARD = 10  # where the schema of an empty dataset lies


def shard_files(spark: SparkSession, path: str) -> dict[int, int]:
    """Files per shard of a written dataset, from the listing alone."""
    jvm = spark.sparkContext._jvm
    found = {}
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for shard in fs.listStatus(folder):
        name = shard.getPath().getName()
        if shard.isDirectory() and name.startswith("shard="):
            found[int(name.removeprefix("shard="))] = sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(shard.getPath()))
    return found


def read_shards(spark: SparkSession, path: str, k: int, columns: list[str] | None = None) -> DataFrame:
    """The first k shards, only the named columns (partition pruning +
    column pruning reach the scan)."""
    df = spark.read.parquet(path).where(F.col("shard") <= k)
    return df.select(*columns) if columns else df


def shards_for_rate(pct: float, n: int = 10) -> int:
    """Percent → shards, min(ceil(pct * n / 100), n), at least 1."""
    return max(1, min(math.ceil(pct * n / 100.0), n))


def sample_rate(spark: SparkSession, path: str, pct: float, columns: list[str] | None = None,
                n: int = 10) -> DataFrame:
    """A nested sample by percent (not df.sample: prefixes must nest)."""
    return read_shards(spark, path, shards_for_rate(pct, n), columns)


def append_shards(spark: SparkSession, path: str, loaded: int, target: int,
                  columns: list[str] | None = None) -> DataFrame:
    """Add shards up to the target; a lower target keeps what is loaded."""
    return read_shards(spark, path, max(loaded, target), columns)


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """Per written file: shard, file, rows, bytes (from the file metadata)."""
    df = spark.read.parquet(path)
    return (df.select("shard", F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_size").alias("bytes"))
            .groupBy("shard", "file").agg(F.count(F.lit(1)).alias("rows"), F.first("bytes").alias("bytes")))


def shard_report(spark: SparkSession, path: str) -> DataFrame:
    """A10: per shard: files, rows, bytes, over the 100 MB limit?; and a total
    row (shard null)."""
    files = file_report(spark, path)
    rep = files.rollup("shard").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"),
                                    F.sum("bytes").alias("bytes"), F.max("bytes").alias("max_file_bytes"))
    return rep.withColumn("over_limit", F.col("max_file_bytes") > SHARD_LIMIT_BYTES)


def cumulative_size(report: DataFrame) -> DataFrame:
    """Running totals over shards 1..n (a table of n rows)."""
    per = report.where(F.col("shard").isNotNull())
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select("shard", "rows", "bytes",
                      F.sum("rows").over(w).alias("cum_rows"), F.sum("bytes").over(w).alias("cum_bytes"))


def input_sizes(spark: SparkSession, pattern: str) -> DataFrame:
    """Sizes of source files without reading their content."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def size_reduction(spark: SparkSession, source_pattern: str, shards_path: str) -> DataFrame:
    """Source bytes, shard bytes, 1 - new/old in percent."""
    old = input_sizes(spark, source_pattern).agg(F.sum("length").alias("old_bytes"),
                                                 F.count(F.lit(1)).alias("old_files"))
    new = file_report(spark, shards_path).agg(F.sum("bytes").alias("new_bytes"),
                                              F.count(F.lit(1)).alias("new_files"))
    both = old.select("*", new.select("new_bytes").scalar().alias("new_bytes"),
                      new.select("new_files").scalar().alias("new_files"))
    return both.withColumn("reduction_pct", reduction_percent(F.col("new_bytes"), F.col("old_bytes")))


def footer_report(spark: SparkSession, path: str, numbers: tuple[str, ...] = ()) -> DataFrame:
    """A10/A4 from the Parquet footers alone: per shard the rows, and the least
    and greatest value of each column in ``numbers`` (no NaN, as ingest leaves
    none), without reading data. The settings this needs hold in a session of
    its own, on the same context."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in numbers:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return own.read.parquet(path).groupBy("shard").agg(*aggs)
