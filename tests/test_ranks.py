from pyspark.sql import Window
from pyspark.sql import functions as F

from cloudsift.operators import ranks as RK
from cloudsift.plans import bindings as B
from tests.conftest import SF_TINY


def test_shuffle_rank_equals_global_row_number(spark):
    cells = B.cells(spark, SF_TINY)
    got = {r.row_id: r.row_idx for r in RK.shuffle_rank(cells, "cell", "row_id").collect()}
    k = F.md5(F.concat(F.lit("42:"), F.col("cell"), F.lit(":"), F.col("row_id").cast("string")))
    ref = cells.select("row_id", (F.row_number().over(Window.orderBy(k, "row_id")) - 1).alias("i"))
    assert got == {r.row_id: r.i for r in ref.collect()}
    assert sorted(got.values()) == list(range(len(got)))


def test_shuffle_rank_stable_across_partitionings(spark):
    cells = B.cells(spark, SF_TINY)
    a = {r.row_id: r.row_idx for r in RK.shuffle_rank(cells.repartition(7), "cell", "row_id", digits=3).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        b = {r.row_id: r.row_idx for r in RK.shuffle_rank(cells.coalesce(1), "cell", "row_id", digits=2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def _sizes(df, col):
    return [r["count"] for r in df.groupBy(col).count().orderBy(col).collect()]


def test_shard_floor_23_rows(spark):
    df = spark.range(23).withColumnRenamed("id", "row_idx")
    out = RK.assign_shards(df, 10)
    assert _sizes(out, "shard") == [2] * 9 + [5]


def test_shard_floor_fewer_rows_than_shards(spark):
    out = RK.assign_shards(spark.range(3).withColumnRenamed("id", "row_idx"), 10)
    assert [r.shard for r in out.collect()] == [10, 10, 10]


def test_even_parts_23_rows(spark):
    out = RK.assign_even_parts(spark.range(23).withColumnRenamed("id", "row_idx"), 10)
    assert _sizes(out, "part") == [3, 3, 3] + [2] * 7
    # same assignment as ntile(10)
    ref = spark.range(23).select("id", F.ntile(10).over(Window.orderBy("id")).alias("p"))
    assert [r.part for r in out.orderBy("row_idx").collect()] == [r.p for r in ref.orderBy("id").collect()]


def test_visible_ordinal_small_buckets(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "row_idx")
    out = RK.visible_ordinal(df, width=64).orderBy("row_idx").collect()
    assert [r.ordinal for r in out] == list(range(len(out)))


def test_line_number_multi_file(spark, tmp_dir):
    data = spark.range(1000).select(F.col("id").cast("string").alias("value"))
    data.orderBy(F.col("value").cast("int")).repartitionByRange(4, F.col("value").cast("int")) \
        .write.mode("overwrite").text(tmp_dir)
    lines = RK.line_number(spark.read.text(tmp_dir)).collect()
    assert sorted((r.line, int(r.value)) for r in lines) == [(i, i) for i in range(1000)]


def test_render_cap_prunes_and_is_exact(spark):
    from cloudsift.operators.export import render_cap
    df = spark.range(0, 20000, 3).withColumnRenamed("id", "row_idx")
    out = render_cap(df, cap=1000, width=256).orderBy("row_idx").collect()
    assert [r.ordinal for r in out] == list(range(1000))
    assert [r.row_idx for r in out] == list(range(0, 3000, 3))
    assert render_cap(df, cap=10 ** 9, width=256).count() == df.count()


def test_copies_of_a_key_spread_over_buckets(spark):
    """A third of the rows share one key value: they must not share a bucket."""
    df = spark.range(3000).select(F.col("id").alias("rid"),
                                  F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    ranked = RK.shuffle_rank(df, "k", "rid", digits=2)
    assert sorted(r.row_idx for r in ranked.collect()) == list(range(3000))
    hot = ranked.where(F.col("k") == "hot").select(RK.shuffle_key("k", 42, "rid").substr(1, 2).alias("b"))
    assert hot.select("b").distinct().count() > 100


def test_stride_sample_is_exact(spark):
    from cloudsift.operators.extent import stride_sample
    df = spark.range(0, 90000, 3).select(F.col("id").alias("row_idx"), (F.col("id") * 2).alias("v")).where(F.col("row_idx") % 7 != 1)
    rows = sorted(r.row_idx for r in df.collect())
    step = len(rows) // 1000
    got = sorted((r.ordinal, r.row_idx, r.v) for r in stride_sample(df, target=1000).collect())
    assert got == [(i, rows[i], rows[i] * 2) for i in range(0, len(rows), step)]


def test_two_digit_part_names_do_not_cut(spark):
    from cloudsift.functions.text import part_name
    nums = spark.range(1, 1201).select("id", part_name(F.lit("/x/cells.tsv.gz"), F.col("id")).alias("n"))
    assert [r.n for r in nums.orderBy("id").collect()] == [f"cells.part{i:02d}.tsv.gz" for i in range(1, 1201)]


def test_values_with_a_common_prefix_rank_in_many_ranges(spark):
    """50 000 values share their first 20 bytes: the largest range is below
    twice the mean, and no exchange brings the values to one task."""
    df = spark.range(50_000).select(F.concat(F.lit("the-same-twenty-byte"), (F.col("id") * 7919 % 50_000).cast("string")).alias("value"), "id")
    ranked = RK.range_rank(df, ["value"], "ord", rows_per_range=2_000)
    rows = ranked.select("value", "ord").collect()
    assert [r.ord for r in sorted(rows, key=lambda r: r.value)] == list(range(50_000))
    sizes = [r["count"] for r in RK.in_ranges(df, ["value"], 2_000).groupBy("_range").count().collect()]
    assert len(sizes) == 25 and max(sizes) < 2 * 50_000 / len(sizes)
    assert "Window" not in ranked._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_range_rank_of_little(spark):
    df = spark.createDataFrame([("b", 1), ("", 2), ("a", 3), ("ä", 4), ("B", 5)], "v string, i int")
    assert [(r.v, r.ord) for r in RK.range_rank(df, ["v"], "ord", 2).orderBy("ord").collect()] == [("", 0), ("B", 1), ("a", 2), ("b", 3), ("ä", 4)]
    assert RK.range_rank(df.where("false"), ["v"], "ord").collect() == []
