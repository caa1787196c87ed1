import gzip
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudsift.operators.permute import Permutation, by_ranges, permute_rows
from cloudsift.plans.ingest import read_keyed, run_ingest
from cloudsift.roles import BINDING_ROLES, REFERENCE_ROLES


def _gz(path, text):
    with gzip.open(path, "wt") as f:
        f.write(text)


def test_ingest_end_to_end(spark, tmp_dir):
    rows_a = "".join(f"{i}.5\t{i}\t{i % 3}\tG{i % 4}\tc{i}\n" for i in range(40))
    _gz(f"{tmp_dir}/a.tsv.gz", "x\ty\tTimeRank\tGene\tcell\n" + rows_a)
    rows_b = "".join(f"{i}.25\tNA\tG{i % 2}\tc{100 + i}\n" for i in range(25))
    _gz(f"{tmp_dir}/b.tsv.gz", "x\tTimeRank\tGene\tcell\n" + rows_b)
    keyed = read_keyed(spark, f"{tmp_dir}/*.tsv.gz")
    assert keyed.count() == 65
    assert keyed.select("source_file", "source_line").distinct().count() == 65
    assert keyed.where(F.col("source_file") == "b.tsv.gz").select(F.min("source_line")).first()[0] == 1
    res = run_ingest(spark, f"{tmp_dir}/*.tsv.gz", f"{tmp_dir}/out", REFERENCE_ROLES)
    ds = spark.read.parquet(res.path)
    assert ds.count() == 65 and ds.select("row_idx").distinct().count() == 65
    assert dict(ds.dtypes)["x"] == "float" and dict(ds.dtypes)["TimeRank"] == "smallint"
    sizes = [r["count"] for r in ds.groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [6] * 9 + [11]
    assert ds.where(F.col("y").isNull()).count() == 25  # missing column in b → null
    counts = {r.source_file: r.n for r in res.rows_per_file.collect()}
    assert counts == {"a.tsv.gz": 40, "b.tsv.gz": 25, None: 65}
    cum = res.cumulative.orderBy("shard").collect()
    assert cum[-1].cum_rows == 65
    red = res.reduction.first()
    assert red.old_files == 2 and red.new_bytes > 0


def test_raw_files_are_read_once(spark, tmp_dir):
    """After the records are staged the raw files may go: later passes over
    types, counts and shards do not touch them."""
    import os
    _gz(f"{tmp_dir}/a.tsv.gz", "x\tGene\tcell\n" + "".join(f"{i}\tG{i}\tc{i}\n" for i in range(50)))
    keyed = read_keyed(spark, f"{tmp_dir}/a.tsv.gz", REFERENCE_ROLES)
    os.rename(f"{tmp_dir}/a.tsv.gz", f"{tmp_dir}/gone")
    assert keyed.count() == 50 and keyed.agg(F.max("x")).first()[0] == 49


def test_ingest_with_a_repeated_row_key(spark, tmp_dir):
    """A row key with three values: every row gets its own place, the same on
    every partitioning, and inferred numbers can be filtered and joined on."""
    roles = replace(BINDING_ROLES, coords=("x",), categorical=("gene",), continuous=(), frame_key=None, row_key="row_id",
                    id_col=None, float_cols=("x",), smallint_cols=())
    for k in range(3):
        _gz(f"{tmp_dir}/{k}.tsv.gz", "row_id\tx\tgene\n" + "".join(f"{i % 3}\t{k * 400 + i}.5\tg{i % 7}\n" for i in range(400)))
    found = []
    for name, parts in (("a", "4"), ("b", "7")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            run_ingest(spark, f"{tmp_dir}/*.tsv.gz", f"{tmp_dir}/{name}", roles)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        ds = spark.read.parquet(f"{tmp_dir}/{name}")
        found.append({(r.row_idx, r.x, r.shard) for r in ds.collect()})
    assert found[0] == found[1] and {i for i, _, _ in found[0]} == set(range(1200))
    assert ds.where("row_id > 0").count() == 1200 - 3 * 134
    assert ds.join(spark.createDataFrame([(2,)], "row_id bigint"), "row_id").count() == 3 * 133
    # shards hold an even share of each third of the input
    for s in range(1, 11):
        mine = [x for _, x, shard in found[0] if shard == s]
        assert len(mine) == 120 and all(20 <= sum(k * 400 <= x < k * 400 + 400 for x in mine) <= 60 for k in range(3))


def test_ingest_moves_rows_once(spark, tmp_dir):
    """One exchange between the staged records and the written shards, dealt
    by arithmetic on row_idx: no sort by a key, no window."""
    _gz(f"{tmp_dir}/a.tsv.gz", "x\tGene\tcell\n" + "".join(f"{i}\tG{i}\tc{i}\n" for i in range(50)))
    df = read_keyed(spark, f"{tmp_dir}/a.tsv.gz", REFERENCE_ROLES)
    placed = by_ranges(permute_rows(df, "source_row", 50), 50, 10)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Window" not in plan.split("Join")[0] and "Sort" not in plan
    tasks = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.min("row_idx").alias("a"), F.max("row_idx").alias("z"), F.count(F.lit(1)).alias("n")).orderBy("a").collect()
    assert sum(t.n for t in tasks) == 50 and all(t.z - t.a + 1 == t.n for t in tasks)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 12345])
def test_keyed_permutation(spark, n):
    net = Permutation(n, 7)
    got = [r[0] for r in permute_rows(spark.range(n), "id", n, 7).orderBy("id").select("row_idx").collect()]
    assert sorted(got) == list(range(n))
    at = np.arange(n, dtype=np.int64)
    at = net.network(at)
    while (at >= n).any():
        at = np.where(at >= n, net.network(at), at)
    assert got == at.tolist()
    if n >= 1000:
        assert got != [r[0] for r in permute_rows(spark.range(n), "id", n, 8).orderBy("id").select("row_idx").collect()]
        cells = np.histogram2d(np.arange(n) * 10 // n, np.array(got) * 10 // n, bins=10)[0]
        assert ((cells - n / 100) ** 2 / (n / 100)).sum() < 150          # 81 degrees of freedom
        assert abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.1
