from pyspark.sql import functions as F

from cloudsift.functions import color as C
from cloudsift.operators import ranks as RK
from cloudsift.session import cluster_conf


def test_bucket_digits_grow_with_rows():
    assert RK._digits_for(10_000) == 2
    assert RK._digits_for(10 ** 9) == 3  # ~954 buckets of ~1M rows
    assert RK._digits_for(10 ** 12) == 5  # 16^5 ≈ 1M buckets


def test_cluster_conf_sizes_partitions_to_data():
    small = cluster_conf(1 << 30, cores=8)
    big = cluster_conf(100 * (1 << 40), cores=8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 4 * 1024 + 1
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_number_text(spark):
    cases = [(1.0, "1"), (-3.0, "-3"), (0.0, "0"), (0.5, "0.5"), (-0.25, "-0.25"), (123456789.125, "1.23456789125E8"), (12345.0, "12345")]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v double")
    got = [r.t for r in df.select("i", C.number_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [t for _, t in cases]
