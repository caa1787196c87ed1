"""The bitmap index against the column filters."""

import random

import pytest
from pyspark.sql import functions as F

from cloudsift.operators import bitmaps as BM
from cloudsift.operators import filters as FL
from cloudsift.plans import bindings as B
from cloudsift.roles import BINDING_ROLES as R
from tests.conftest import SF_TINY


def _spec(i, attribute=None, values=None, rng=None):
    kind = None if attribute is None else "continuous" if attribute == "t" else "categorical"
    return FL.FilterSpec(i, attribute, kind, values, rng)


@pytest.fixture(scope="module")
def points(spark):
    return B.sharded(spark, SF_TINY)


@pytest.fixture(scope="module")
def index(spark, points):
    return BM.build_index(points, R)


def _same(points, index, specs, k=None):
    part = points if k is None else points.where(F.col("shard") <= k)
    want = sorted(r.row_idx for r in FL.filter_all(part, specs).select("row_idx").collect())
    assert sorted(r.row_idx for r in BM.bitmap_filter(index, specs, k).collect()) == want
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(BM.bitmap_funnel(index, specs, k)) == key(FL.filter_funnel(part, specs))


def test_random_filter_lists(spark, points, index):
    r = random.Random(1)
    domain = {a: [v[0] for v in points.select(FL.norm_category(F.col(a))).distinct().collect()] for a in ("structure", "hf", "gene")}
    for trial in range(6):
        specs = []
        for i in range(r.randrange(4)):
            a = r.choice([None, "structure", "hf", "gene", "t", "t"])
            if a == "t":
                lo = r.uniform(-5, 500)
                specs.append(_spec(i, a, None, (lo, lo + r.uniform(-20, 300))))
            elif a:
                specs.append(_spec(i, a, tuple(r.sample(domain[a], min(len(domain[a]), r.randrange(4))) + ["no such value"] * r.randrange(2))))
            else:
                specs.append(_spec(i))
        _same(points, index, specs, r.choice([None, 1, 4]))


def test_ends_nulls_and_missing_values(spark, points, index):
    lo, hi = points.agg(F.min("t"), F.max("t")).first()
    _same(points, index, [_spec(1, "t", None, (lo, hi)), _spec(2, "structure", ("",))])
    _same(points, index, [_spec(1, "structure", ("no such value",)), _spec(2, "t", None, (lo, hi))])
    _same(points, index, [])


def test_the_dataset_is_not_read_again(points, index):
    specs = [_spec(1, "structure", ("click", "")), _spec(2, "t", None, (10.0, 400.0))]
    plan = BM.bitmap_filter(index, specs)._jdf.queryExecution().executedPlan().toString()
    assert B.shards_path(index.spark, SF_TINY) not in plan
    assert "ReadSchema: struct<shard:int,row_idx:bigint,value:double>" in plan or "ReadSchema: struct<row_idx:bigint,value:double>" in plan
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,10.0), LessThanOrEqual(value,400.0)]" in plan
    assert "attribute" in plan and "Exchange SinglePartition" not in plan


def test_many_buckets_hot_values_and_gaps(spark, tmp_dir):
    """Row numbers over many buckets with gaps, one value on a third of the
    rows, an attribute with too many values."""
    df = spark.range(0, 200_000, 1, 8).where(F.col("id") % 5 != 2).select(
        (F.col("id") * 3).alias("row_idx"), (F.col("id") % 10 + 1).cast("int").alias("shard"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 11).cast("string"))).alias("structure"),
        F.col("id").cast("string").alias("gene"), F.when(F.col("id") % 4 == 0, F.lit(7.0)).otherwise((F.col("id") % 100).cast("double")).alias("t"))
    index = BM.build_index(df, R, f"{tmp_dir}/i", max_values=100)
    assert index.categorical == ("structure",)
    for specs in ([_spec(1, "structure", ("hot", "v3")), _spec(2, "t", None, (7.0, 40.0))], [_spec(1, "t", None, (7.0, 7.0))]):
        _same(df, index, specs)
        _same(df, index, specs, 3)
    with pytest.raises(KeyError):
        BM.bitmap_filter(index, [_spec(1, "gene", ("1",))])


def test_empty_dataset(spark, points, tmp_dir):
    index = BM.build_index(points.where("false"), R, f"{tmp_dir}/i")
    _same(points.where("false"), index, [_spec(1, "t", None, (0.0, 1.0)), _spec(2)])


def test_a_bucket_meets_in_one_task(spark, points, monkeypatch):
    """Rows in any order: no bucket is split over tasks (each would make a
    bitmap of 4 KB for nearly every value), and the tasks follow the rows."""
    monkeypatch.setattr(BM, "ROWS_PER_TASK", 100)
    spread = points.unionAll(points.withColumn("row_idx", F.col("row_idx") + 200_000)).repartition(6, "row_id")
    index = BM.build_index(spread, R)
    assert index.tasks == -(-spread.count() // 100) > 2
    met = BM._by_bucket(spread.select("row_idx"), index.tasks)
    assert met.rdd.getNumPartitions() == index.tasks
    assert met.select("bucket", F.spark_partition_id()).distinct().count() == met.select("bucket").distinct().count()
    for part in ("rows", "values"):
        got = index.read(part)
        keys = [c for c in got.columns if c != "bits"]
        assert got.groupBy(*keys).count().where("count > 1").count() == 0
    _same(spread, index, [_spec(1, "structure", ("click", "")), _spec(2, "t", None, (10, 200))])
