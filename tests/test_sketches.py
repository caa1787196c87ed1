"""Distinct-count sketches per shard against exact counts."""

import random

from pyspark.sql import functions as F

from cloudsift.operators import profile as PF
from cloudsift.operators import sketches as SK
from cloudsift.roles import BINDING_ROLES as R
from cloudsift.sources import shards as SH


def _points(spark, n=60_000):
    """An id that is unique, one with 9 000 values of which one holds a third
    of the rows, nulls and ''."""
    i = F.col("row_idx")
    return spark.range(n).withColumnRenamed("id", "row_idx").select(
        "row_idx", F.least(F.floor(i / (n // 10)) + 1, F.lit(10)).cast("int").alias("shard"), i.cast("string").alias("cell"),
        F.when(i % 3 == 0, "hot").otherwise((i * 31 % 9001).cast("string")).alias("gene"),
        F.when(i % 7 == 0, None).when(i % 7 == 1, "").otherwise((i % 5).cast("string")).alias("structure"))


def _close(est, exact):
    est, exact = ({r.attribute: r.n_distinct for r in d.collect()} for d in (est, exact))
    assert set(est) == {"cell", "gene", "structure"}
    for a, n in est.items():
        assert abs(n - exact[a]) <= 0.02 * exact[a], (a, n, exact[a])


def test_estimates_and_appended_shards(spark, tmp_dir):
    points = _points(spark)
    SH.write_shards(points.where("shard <= 4"), f"{tmp_dir}/d")
    assert SK.update_sketches(spark, f"{tmp_dir}/d", f"{tmp_dir}/s", R) == [1, 2, 3, 4]
    _close(SK.estimated_counts(spark.read.parquet(f"{tmp_dir}/s")), PF.distinct_counts(points.where("shard <= 4"), R))
    (points.where("shard > 4").write.mode("append").partitionBy("shard").parquet(f"{tmp_dir}/d"))
    assert SK.update_sketches(spark, f"{tmp_dir}/d", f"{tmp_dir}/s", R) == [5, 6, 7, 8, 9, 10]
    assert SK.update_sketches(spark, f"{tmp_dir}/d", f"{tmp_dir}/s", R) == []
    kept = spark.read.parquet(f"{tmp_dir}/s")
    assert kept.count() == 30
    _close(SK.estimated_counts(kept), PF.distinct_counts(points, R))
    _close(SK.estimated_counts(kept, 3), PF.distinct_counts(points.where("shard <= 3"), R))


def test_order_of_merges_does_not_matter(spark):
    rows = SK.shard_sketches(_points(spark, 20_000), R).collect()
    found = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "shard int, attribute string, sketch binary").repartition(1 + seed)
        found.add(tuple(sorted(map(tuple, SK.estimated_counts(df).collect()))))
    assert len(found) == 1


def test_nothing_to_count(spark):
    points = _points(spark, 10)
    assert SK.estimated_counts(SK.shard_sketches(points.where("false"), R)).collect() == []
    none = points.withColumns({c: F.lit(None).cast("string") for c in ("gene", "structure", "cell")})
    assert {r.n_distinct for r in SK.estimated_counts(SK.shard_sketches(none, R)).collect()} == {0}
