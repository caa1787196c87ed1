import os

from pyspark.sql import functions as F

from cloudsift.operators import filters as FL
from cloudsift.operators import profile as PF
from cloudsift.plans import bindings as B
from cloudsift.roles import BINDING_ROLES as R
from cloudsift.sources import shards as SH
from cloudsift.streaming import progressive as PG
from tests.conftest import SF_TINY


def test_progressive_end_state_equals_batch(spark, tmp_dir):
    SH.write_shards(B.points(spark, SF_TINY).drop("n_rows"), tmp_dir)
    batch = spark.read.parquet(tmp_dir)
    rows = PG.progressive_load(spark, tmp_dir, ["row_idx", "shard"])
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, batch.select("row_idx", "shard").collect()))
    dom = PG.progressive_domain(spark, tmp_dir, R)
    ref = PF.attribute_domain(batch, R)
    assert sorted(map(tuple, dom.select("attribute", "value", "n").collect())) == \
        sorted(map(tuple, ref.collect()))
    hist, end = PG.progressive_summary(spark, tmp_dir, R)
    assert end.first().rows == batch.count()
    ref = [batch.where(F.col("shard") <= k).agg(F.count(F.lit(1)).alias("rows"), F.min("t").alias("a"), F.max("t").alias("z")).first()
           for k in range(1, 11)]
    assert [(r.shard, r.rows, r.min_t, r.max_t) for r in hist.orderBy("shard").collect()] == \
        [(k + 1, r.rows, r.a, r.z) for k, r in enumerate(ref)]
    spec = [FL.FilterSpec(1, "grp", "categorical", ("AM",))]
    filt = PG.progressive_filter(spark, tmp_dir, spec, ["row_idx"])
    assert filt.count() == batch.where(F.col("grp") == "AM").count()


def test_shards_arrive_one_by_one_in_order(spark, tmp_dir):
    SH.write_shards(B.points(spark, SF_TINY).drop("n_rows"), f"{tmp_dir}/d", rows_per_file=17)   # many files a shard
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = PG.arrivals(spark, f"{tmp_dir}/d", f"{tmp_dir}/out", lambda d, k: d.select("shard"), start=2)
    assert seen == list(range(3, 11))
    got = spark.read.parquet(f"{tmp_dir}/out").groupBy("epoch").agg(F.min("shard").alias("a"), F.max("shard").alias("z")).orderBy("epoch").collect()
    assert [(r.a, r.z) for r in got] == [(k, k) for k in range(3, 11)]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def _part(spark, src, dst, lo, hi):
    """Shards lo .. hi of a dataset arrive in another folder."""
    (spark.read.parquet(src).where(F.col("shard").between(lo, hi)).sortWithinPartitions("shard", "row_idx")
     .write.mode("append").partitionBy("shard").parquet(dst))


def _results(spark, path, state):
    spec = [FL.FilterSpec(1, "grp", "categorical", ("AM",))]
    rows = PG.progressive_load(spark, path, ["row_idx", "shard"], f"{state}/t1")
    dom = PG.progressive_domain(spark, path, R, f"{state}/t2")
    hist, end = PG.progressive_summary(spark, path, R, state=f"{state}/t3")
    kept = PG.progressive_filter(spark, path, spec, ["row_idx"], f"{state}/t4")
    return [sorted(map(tuple, d.collect()), key=str) for d in (rows, dom.select("attribute", "value", "n"), hist, end, kept)]


def _batch(spark, path):
    d = spark.read.parquet(path)
    n, box = F.count(F.lit(1)), [g(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in "xyz" for g in (F.min, F.max)]
    run = [d.where(F.col("shard") <= k).agg(F.max("shard"), n, F.min("t"), F.max("t"), *box).first() for k in range(1, 11)]
    run = [r for k, r in enumerate(run, 1) if r[0] == k]
    end = d.agg(n, F.min("t"), F.max("t"), *box).collect()
    kept = d.where(F.col("grp") == "AM").select("row_idx").collect()
    dom = PF.attribute_domain(d, R).select("attribute", "value", "n").collect()
    return [sorted(map(tuple, x), key=str) for x in (d.select("row_idx", "shard").collect(), dom, run, end, kept)]


def test_loading_goes_on_from_its_state(spark, tmp_dir):
    """Four shards, then the other six: the second call takes only what is new,
    and ends where the batch ends."""
    SH.write_shards(B.points(spark, SF_TINY).drop("n_rows"), f"{tmp_dir}/all")
    _part(spark, f"{tmp_dir}/all", f"{tmp_dir}/d", 1, 4)
    assert _results(spark, f"{tmp_dir}/d", f"{tmp_dir}/s") == _batch(spark, f"{tmp_dir}/d")
    epochs = PG.committed_epochs(spark, f"{tmp_dir}/s/t2/checkpoint")
    _part(spark, f"{tmp_dir}/all", f"{tmp_dir}/d", 5, 10)
    assert _results(spark, f"{tmp_dir}/d", f"{tmp_dir}/s") == _batch(spark, f"{tmp_dir}/all")
    assert epochs < PG.committed_epochs(spark, f"{tmp_dir}/s/t2/checkpoint")
    # nothing new: nothing changes
    assert _results(spark, f"{tmp_dir}/d", f"{tmp_dir}/s") == _batch(spark, f"{tmp_dir}/all")


def _forget(folder, name):
    for f in (name, f".{name}.crc"):
        if os.path.exists(f"{folder}/{f}"):
            os.remove(f"{folder}/{f}")


def test_killed_between_write_and_commit(spark, tmp_dir):
    """The last epoch's rows are written but its commit is missing, once with
    and once without the sink's own log entry: started again, every row comes
    once; before that, readers see the committed epochs only."""
    SH.write_shards(B.points(spark, SF_TINY).drop("n_rows"), f"{tmp_dir}/all")
    _part(spark, f"{tmp_dir}/all", f"{tmp_dir}/d", 1, 5)
    _results(spark, f"{tmp_dir}/d", f"{tmp_dir}/s")
    for t in ("t1", "t2", "t3", "t4"):
        last = PG.committed_epochs(spark, f"{tmp_dir}/s/{t}/checkpoint")
        _forget(f"{tmp_dir}/s/{t}/checkpoint/commits", str(last))
        if t == "t1":
            before = spark.read.parquet(f"{tmp_dir}/s/t1/rows").count()
            _forget(f"{tmp_dir}/s/t1/rows/_spark_metadata", str(last))
            assert 0 < spark.read.parquet(f"{tmp_dir}/s/t1/rows").count() < before       # its files are there, its entry is not
        assert PG.committed_epochs(spark, f"{tmp_dir}/s/{t}/checkpoint") == last - 1
    assert _results(spark, f"{tmp_dir}/d", f"{tmp_dir}/s") == _batch(spark, f"{tmp_dir}/d")
    _part(spark, f"{tmp_dir}/all", f"{tmp_dir}/d", 6, 10)
    assert _results(spark, f"{tmp_dir}/d", f"{tmp_dir}/s") == _batch(spark, f"{tmp_dir}/all")


def test_empty_dataset(spark, tmp_dir):
    """No rows: the dataset keeps its columns, and every reader gives an empty
    table or, for totals, one row."""
    none = B.points(spark, SF_TINY).drop("n_rows").where("false")
    SH.write_shards(none, f"{tmp_dir}/d")
    ds = spark.read.parquet(f"{tmp_dir}/d")
    assert sorted(ds.dtypes) == sorted(none.dtypes) and ds.count() == 0
    assert SH.read_shards(spark, f"{tmp_dir}/d", 3, ["x"]).count() == 0 and SH.sample_rate(spark, f"{tmp_dir}/d", 100).count() == 0
    assert SH.append_shards(spark, f"{tmp_dir}/d", 2, 3).count() == 0
    assert PG.arrivals(spark, f"{tmp_dir}/d", f"{tmp_dir}/out", lambda d, k: d) == []
    got = _results(spark, f"{tmp_dir}/d", f"{tmp_dir}/s")
    assert got == [[], [], [], [(0, *[None] * 8)], []]
    SH.write_shards(B.points(spark, SF_TINY).drop("n_rows"), f"{tmp_dir}/d")             # replaced by rows
    assert spark.read.parquet(f"{tmp_dir}/d").count() == B.cells(spark, SF_TINY).count()


def test_state_lies_in_the_rocksdb_store(spark, tmp_dir):
    SH.write_shards(B.points(spark, SF_TINY).drop("n_rows"), f"{tmp_dir}/d")
    PG.progressive_domain(spark, f"{tmp_dir}/d", R, f"{tmp_dir}/s")
    names = [f for d, _, fs in os.walk(f"{tmp_dir}/s/checkpoint/state") for f in fs]
    assert any(f.endswith((".zip", ".changelog")) for f in names), names[:5]
