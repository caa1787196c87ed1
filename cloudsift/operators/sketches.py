"""Mergeable distinct counts per shard (A5, U2, U3 on a growing dataset).

A theta sketch (the least ``2^LG_K`` hashes) per (shard, attribute) is kept
beside the dataset, in a folder partitioned like it. When shards arrive, only
they are read; the count of any prefix of shards is a union of a few sketches,
the same in any order (a HyperLogLog union is not, which is why it is not used
here). Up to ``2^LG_K`` values the count is exact, beyond that within about
1 %; the exact way is ``distinct_counts``. Nulls are not counted, '' is a
value. No shards, or an attribute without values, count 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.roles import Roles
from cloudsift.sources.shards import shard_files

LG_K = 16


def shard_sketches(df: DataFrame, roles: Roles) -> DataFrame:
    """(shard, attribute, sketch) of the categoricals and the id column in one
    scan: a partial sketch per task, one row per shard and attribute moves."""
    attrs = [a for a in (*roles.categorical, *([roles.id_col] if roles.id_col else [])) if a in df.columns]
    marked = lambda a: F.concat(F.lit("="), F.col(a).cast("string"))  # noqa: E731  sketches leave out '' itself
    per = df.groupBy("shard").agg(*(F.theta_sketch_agg(marked(a), LG_K).alias(f"s{i}") for i, a in enumerate(attrs)))
    return per.select("shard", F.inline(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(f"s{i}").alias("sketch")) for i, a in enumerate(attrs)))))


def update_sketches(spark: SparkSession, dataset: str, store: str, roles: Roles) -> list[int]:
    """Add the sketches of the shards that ``store`` does not have yet, reading
    those shards only; the shards added. A shard is one folder of the store,
    written whole, so a call that failed half-way is simply made again."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    known = shard_files(spark, store) if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there) else {}
    new = sorted(k for k in shard_files(spark, dataset) if not known.get(k))
    if new:
        rows = spark.read.parquet(dataset).where(F.col("shard").isin(new))
        (shard_sketches(rows, roles).repartition(len(new), "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("shard").parquet(store))
    return new


def estimated_counts(sketches: DataFrame, shards: int | None = None) -> DataFrame:
    """(attribute, n_distinct) over all shards, or the first ``shards``."""
    if shards is not None:
        sketches = sketches.where(F.col("shard") <= shards)
    return sketches.groupBy("attribute").agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", LG_K)).alias("n_distinct"))
