import gzip
import os

import pytest
from pyspark.sql import functions as F

from cloudsift.plans import bindings as B
from cloudsift.sources import shards as SH
from cloudsift.sources import tables as TB
from cloudsift.sources import text_split as TS
from tests.conftest import SF_TINY


def _write_gz(path, text: bytes):
    with gzip.open(path, "wb") as f:
        f.write(text)


def test_read_tables_na_tokens_and_types(spark, tmp_dir):
    _write_gz(f"{tmp_dir}/b.tsv.gz", b"x\tGene\tTimeRank\n1.5\tNA\t3\n2\tKrt14\t\n")
    _write_gz(f"{tmp_dir}/a.tsv.gz", b"x\tGene\tTimeRank\n0.25\tnull\t1\n")
    df = TB.read_tables(spark, f"{tmp_dir}/*.tsv.gz", with_source=True).drop("source_line")
    counts = {r.file: r.n for r in TB.row_counts(df).collect()}
    assert counts == {"a.tsv.gz": 1, "b.tsv.gz": 2, None: 3}
    df = df.drop("source_file")
    assert dict(df.dtypes) == {"x": "double", "Gene": "string", "TimeRank": "double"}
    rows = sorted((r.x, r.Gene, r.TimeRank) for r in df.collect())
    assert rows == [(0.25, None, 1.0), (1.5, None, 3.0), (2.0, "Krt14", None)]


def test_read_tables_as_pandas_reads(spark, tmp_dir):
    """Columns by name, ids that look like numbers, blank lines, quoted
    headers, quotes and line breaks in fields: the pandas reader is the
    measure."""
    import pandas as pd
    files = {
        "a": 'x\ty\tcell\n1\t2\t12d\n\n3\t4\t7f\n',
        "b": '"y"\t"x"\t"Gene"\n20\t10\t"two\nlines"\n21\t11\t"a ""q"" b"\n\n',
        "c": 'cell\tx\ty\n007\t-1e3\t+.5\n',
    }
    for n, t in files.items():
        _write_gz(f"{tmp_dir}/{n}.tsv.gz", t.encode())
    want = pd.concat([pd.read_csv(f"{tmp_dir}/{n}.tsv.gz", sep="\t", dtype={"cell": str}) for n in files])
    df = TB.read_tables(spark, f"{tmp_dir}/*.tsv.gz", text_columns=("cell",))
    assert dict(df.dtypes) == {"x": "double", "y": "double", "cell": "string", "Gene": "string"}
    none = lambda v: None if v is None or v != v else v
    key = lambda r: r[0]
    assert sorted(((r.x, r.y, r.cell, r.Gene) for r in df.collect()), key=key) == \
        sorted(((float(r.x), float(r.y), none(r.cell), none(r.Gene)) for r in want.itertuples()), key=key)
    lines = {(r.source_file, r.source_line) for r in TB.read_tables(spark, f"{tmp_dir}/*.tsv.gz", with_source=True).collect()}
    assert lines == {("a.tsv.gz", 1), ("a.tsv.gz", 2), ("b.tsv.gz", 1), ("b.tsv.gz", 2), ("c.tsv.gz", 1)}
    ids = TB.read_tables(spark, f"{tmp_dir}/a.tsv.gz")
    assert dict(ids.dtypes)["cell"] == "string"          # 12d is not a number


def test_inferred_numbers_can_be_used(spark, tmp_dir):
    """Filter, join, dropna and a given schema on numeric columns: no plan
    casts the header's text."""
    for k in range(2):
        _write_gz(f"{tmp_dir}/{k}.tsv.gz", b"row_id\tv\tname\n" + b"".join(b"%d\t%d.5\tn%d\n" % (i + 10 * k, i, i) for i in range(10)))
    df = TB.read_tables(spark, f"{tmp_dir}/*.tsv.gz")
    assert dict(df.dtypes) == {"row_id": "bigint", "v": "double", "name": "string"}
    assert df.where("row_id > 5").count() == 14 and df.where("v < 3").count() == 6
    assert df.dropna(subset=["row_id"]).count() == 20
    keys = spark.createDataFrame([(3,), (17,), (99,)], "row_id bigint")
    assert sorted(r.name for r in df.join(keys, "row_id").collect()) == ["n3", "n7"]
    assert df.join(df.select("row_id"), "row_id", "left_semi").where("v + row_id > 20").count() == 5
    typed = TB.read_tables(spark, f"{tmp_dir}/*.tsv.gz", schema="row_id int, v float")
    assert typed.where("row_id >= 18").count() == 2 and dict(typed.dtypes)["v"] == "float"
    assert df.groupBy("row_id").count().where("row_id = 4").first()["count"] == 1


def test_nothing_is_lost_silently(spark, tmp_dir):
    import pandas as pd
    _write_gz(f"{tmp_dir}/eq.tsv.gz", b"\ta\tb\ta\n0\t1\t2\t3\n1\t4\t5\t6\n")
    df = TB.read_tables(spark, f"{tmp_dir}/eq.tsv.gz")
    want = pd.read_csv(f"{tmp_dir}/eq.tsv.gz", sep="\t")
    assert df.columns == list(want.columns) == ["Unnamed: 0", "a", "b", "a.1"]
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.values.tolist()))
    _write_gz(f"{tmp_dir}/wide.tsv.gz", b"a\tb\n1\t2\n1\t2\t3\n")
    with pytest.raises(ValueError, match="more fields"):
        TB.read_tables(spark, f"{tmp_dir}/wide.tsv.gz")
    _write_gz(f"{tmp_dir}/twice.tsv.gz", b"a\ta.1\ta\n1\t2\t3\n")
    with pytest.raises(ValueError, match="told apart"):
        TB.read_tables(spark, f"{tmp_dir}/twice.tsv.gz")
    _write_gz(f"{tmp_dir}/key.tsv.gz", b"a\tsource_line\n1\t2\n")
    with pytest.raises(ValueError, match="named"):
        TB.read_tables(spark, f"{tmp_dir}/key.tsv.gz")
    with pytest.raises(ValueError, match="max_columns"):
        TB.read_records(spark, f"{tmp_dir}/eq.tsv.gz", max_columns=3)


def test_plain_files_are_split(spark, tmp_dir):
    """A plain file is read in many tasks, its lines numbered over all splits;
    rows of missing values stay, blank lines go."""
    lines = [f"{i}\tv{i}\t" for i in range(20_000)]
    lines[7] = "\t\t"
    with open(f"{tmp_dir}/a.tsv", "w") as f:
        f.write("id\tv\tw\n\n" + "\n".join(lines) + "\n\n")
    with open(f"{tmp_dir}/b.tsv", "w") as f:
        f.write("w\tid\nx\t5\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        df = TB.read_tables(spark, f"{tmp_dir}/*.tsv", with_source=True, with_number=True, infer=False)
        raw = TB._raw_records(spark, TB.list_inputs(spark, f"{tmp_dir}/a.tsv"), "\t", ["_c0", "_c1", "_c2", "_c3"], False)
        assert raw.rdd.getNumPartitions() > 3
        rows = df.orderBy("source_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.source_row for r in rows] == list(range(20_001))
    assert [r.source_line for r in rows] == [*range(1, 20_001), 1]
    assert [r.id for r in rows] == [None if i == 7 else str(i) for i in range(20_000)] + ["5"]
    assert rows[-1].w == "x" and rows[3].v == "v3" and rows[3].w is None and rows[-1].v is None


def test_header_only_and_empty_files(spark, tmp_dir):
    _write_gz(f"{tmp_dir}/a.tsv.gz", b"x\ty\n")
    _write_gz(f"{tmp_dir}/b.tsv.gz", b"")
    df = TB.read_tables(spark, f"{tmp_dir}/*.tsv.gz", with_source=True, with_number=True)
    assert df.columns == ["x", "y", *TB.SOURCE_KEY] and df.count() == 0


def test_read_tables_empty_glob_fails(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        TB.read_tables(spark, f"{tmp_dir}/*.tsv.gz")


def test_union_unlike_columns(spark):
    a = spark.createDataFrame([(1.0, "g")], "x double, g string")
    b = spark.createDataFrame([(2.0,)], "x double")
    rows = sorted(TB.union_tables([a, b]).collect(), key=lambda r: r.x)
    assert (rows[1].x, rows[1].g) == (2.0, None)


def test_normalise_types(spark):
    df = spark.createDataFrame([(1.0, 5, "a", float("nan"))], "x double, TimeRank long, Gene string, Time double")
    from cloudsift.roles import REFERENCE_ROLES
    out = TB.normalise_types(df, REFERENCE_ROLES)
    assert dict(out.dtypes) == {"x": "float", "TimeRank": "smallint", "Gene": "string", "Time": "float"}
    assert out.first().Time is None
    big = spark.createDataFrame([(40000,)], "TimeRank long")
    assert TB.normalise_types(big, REFERENCE_ROLES, strict=False).first().TimeRank is None


def test_shards_disjoint_cover_nest(spark, tmp_dir):
    pts = B.points(spark, SF_TINY).drop("n_rows")
    SH.write_shards(pts, tmp_dir, rows_per_file=300)
    ds = spark.read.parquet(tmp_dir)
    total = pts.count()
    assert ds.count() == total and ds.select("row_idx").distinct().count() == total
    sizes = [r["count"] for r in ds.groupBy("shard").count().orderBy("shard").collect()]
    per = total // 10
    assert sizes == [per] * 9 + [total - 9 * per]
    k2 = {r.row_idx for r in SH.read_shards(spark, tmp_dir, 2, ["row_idx"]).collect()}
    k3 = {r.row_idx for r in SH.read_shards(spark, tmp_dir, 3, ["row_idx"]).collect()}
    assert k2 < k3
    # a shard is a uniform sample: category shares near the global ones
    share = ds.groupBy("grp").count().collect()
    s1 = {r.grp: r["count"] for r in ds.where("shard = 1").groupBy("grp").count().collect()}
    for r in share:
        assert abs(s1.get(r.grp, 0) / per - r["count"] / total) < 0.15
    plan = SH.read_shards(spark, tmp_dir, 2, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "ReadSchema: struct<x:double>" in plan


@pytest.mark.parametrize("pct,k", [(1, 1), (10, 1), (11, 2), (100, 10)])
def test_sample_rate_shards(pct, k):
    assert SH.shards_for_rate(pct) == k


def test_append_keeps_high_water_mark(spark, tmp_dir):
    pts = B.points(spark, SF_TINY).drop("n_rows")
    SH.write_shards(pts, tmp_dir)
    assert SH.append_shards(spark, tmp_dir, 5, 3, ["row_idx"]).count() == \
        SH.read_shards(spark, tmp_dir, 5, ["row_idx"]).count()


def _split(spark, tmp_dir, text: bytes, n: int):
    src = f"{tmp_dir}/in/data.csv.gz"
    os.makedirs(os.path.dirname(src))
    _write_gz(src, text)
    out = f"{tmp_dir}/out"
    names = TS.split_with_header(spark, src, out, n)
    parts = []
    for p in sorted(names):
        with gzip.open(p.replace("file:", ""), "rb") as f:
            parts.append(f.read().decode("utf-8").splitlines())
    return names, parts


def test_split_23_rows_10_parts(spark, tmp_dir):
    lines = ["h1,h2"] + [f"{i},v{i}" for i in range(23)]
    names, parts = _split(spark, tmp_dir, ("\n".join(lines) + "\n").encode(), 10)
    assert [os.path.basename(n) for n in sorted(names)][:2] == ["data.part01.csv.gz", "data.part02.csv.gz"]
    assert [len(p) - 1 for p in parts] == [3, 3, 3] + [2] * 7
    assert all(p[0] == "h1,h2" for p in parts)
    assert [x for p in parts for x in p[1:]] == lines[1:]


def test_split_keeps_every_line(spark, tmp_dir):
    """More than 99 parts, several input files, and a session that limits the
    records of a file: no line is lost."""
    os.makedirs(f"{tmp_dir}/in")
    lines = [f"{i},v{i}" for i in range(1000)]
    for k in range(4):
        _write_gz(f"{tmp_dir}/in/{k}.csv.gz", ("\n".join(["h1,h2", *lines[k * 250:k * 250 + 250]]) + "\n").encode())
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        names = TS.split_with_header(spark, f"{tmp_dir}/in/*.gz", f"{tmp_dir}/out", 120, every_file_has_header=True)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [os.path.basename(n) for n in names] == [f"0.part{i:02d}.csv.gz" for i in range(1, 121)]
    got = []
    for n in names:
        with gzip.open(n.replace("file:", ""), "rt") as f:
            head, *rest = f.read().splitlines()
            assert head == "h1,h2"
            got += rest
    assert got == lines
    assert not [x for x in os.listdir(f"{tmp_dir}/out") if x.startswith("part=")]


def test_split_header_only_and_bad_utf8(spark, tmp_dir):
    _, parts = _split(spark, tmp_dir, b"h\n", 3)
    assert parts == [["h"], ["h"], ["h"]]


def test_split_bad_utf8(spark, tmp_dir):
    _, parts = _split(spark, tmp_dir, b"h\na\xffb\n", 1)
    assert parts == [["h", "a�b"]]


def test_split_errors(spark, tmp_dir):
    with pytest.raises(ValueError):
        TS.split_with_header(spark, f"{tmp_dir}/x.gz", f"{tmp_dir}/o", 0)
    with pytest.raises(FileNotFoundError):
        TS.split_with_header(spark, f"{tmp_dir}/none*.gz", f"{tmp_dir}/o", 2)
    src = f"{tmp_dir}/empty.txt.gz"
    _write_gz(src, b"")
    with pytest.raises(ValueError):
        TS.split_with_header(spark, src, f"{tmp_dir}/o2", 2)


def test_parts_for_limit(spark, tmp_dir):
    src = f"{tmp_dir}/big.csv.gz"
    with gzip.open(src, "wb", compresslevel=0) as f:
        f.write(b"h\n" + b"x" * 5000 + b"\n")
    assert TS.parts_for_limit(spark, src, limit_bytes=1000) >= 5
    assert TS.parts_for_limit(spark, src) == 1


def test_footer_report_reads_no_data(spark, tmp_dir):
    """Rows and ranges are pushed to the footers; they equal the scan's."""
    SH.write_shards(B.points(spark, SF_TINY).drop("n_rows"), f"{tmp_dir}/d", rows_per_file=40)      # several files a shard
    got = SH.footer_report(spark, f"{tmp_dir}/d", ("t", "x", "time_rank"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(t), MAX(t), MIN(x), MAX(x), MIN(time_rank), MAX(time_rank)]" in plan
    assert "PushedGroupBy: [shard]" in plan
    aggs = [f"{f}({c})" for c in ("t", "x", "time_rank") for f in ("min", "max")]
    want = spark.read.parquet(f"{tmp_dir}/d").groupBy("shard").agg(F.count(F.lit(1)), *map(F.expr, aggs))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_reported_bytes_are_the_files_sizes(spark, tmp_dir):
    """Bytes per shard, in total, and per part, as the file
    system has them."""
    import glob
    SH.write_shards(B.points(spark, SF_TINY).drop("n_rows"), f"{tmp_dir}/d", rows_per_file=40)
    size = {k: [os.path.getsize(f) for f in glob.glob(f"{tmp_dir}/d/shard={k}/*.parquet")] for k in range(1, 11)}
    rep = {r.shard: r for r in SH.shard_report(spark, f"{tmp_dir}/d").collect()}
    assert {k: (rep[k].files, rep[k].bytes, rep[k].max_file_bytes, rep[k].over_limit) for k in size} == \
        {k: (len(v), sum(v), max(v), False) for k, v in size.items()}
    assert rep[None].bytes == sum(map(sum, size.values())) and rep[None].files == sum(map(len, size.values()))
    cum = SH.cumulative_size(SH.shard_report(spark, f"{tmp_dir}/d")).orderBy("shard").collect()
    assert [r.cum_bytes for r in cum] == [sum(sum(size[j]) for j in range(1, k + 1)) for k in range(1, 11)]
    _write_gz(f"{tmp_dir}/a.tsv.gz", b"x\n" + b"1\n" * 5000)
    red, old = SH.size_reduction(spark, f"{tmp_dir}/*.gz", f"{tmp_dir}/d").first(), os.path.getsize(f"{tmp_dir}/a.tsv.gz")
    new = rep[None].bytes
    assert (red.old_bytes, red.new_bytes, red.old_files) == (old, new, 1) and abs(red.reduction_pct - 100 * (1 - new / old)) < 1e-9
    names = TS.split_with_header(spark, f"{tmp_dir}/a.tsv.gz", f"{tmp_dir}/p", 4)
    mib = [os.path.getsize(n.replace("file:", "")) / 2**20 for n in names]
    part = TS.part_report(spark, f"{tmp_dir}/p").first()
    assert part.parts == 4 and abs(part.max_mib - max(mib)) < 1e-12 and abs(part.min_mib - min(mib)) < 1e-12
    assert abs(part.avg_mib - sum(mib) / 4) < 1e-12 and part.any_over_limit is False


def test_no_more_fields_are_parsed_than_a_record_can_have(spark, tmp_dir):
    """The widest record sets the columns; quotes that stay open at the end of
    a line leave them at the most."""
    most = TB.MAX_COLUMNS + 1
    def width(text, sep="\t", multi_line=True):
        _write_gz(f"{tmp_dir}/w.gz", text)
        return TB._widest_record(spark, [f"{tmp_dir}/w.gz"], sep, most, multi_line)
    assert width(b"a\tb\tc\n1\t2\t3\n") == 3
    assert width(b"a\tb\n1\t2\t3\t4\n") == 4                       # a record wider than the header is still seen
    assert width(b'a\tb\n""\t"x ""y"" z"\n"1"\t2\r\n') == 2
    assert width(b'a\tb\n1\t"x\n2\t3"\n') == most
    assert width(b'a\tb\n1"\t"x\n') == most
    assert width(b'a\tb\n1\t"x\n', multi_line=False) == 2
    assert width(b"a||b||c\n", "||") == 3
    assert width(b"\n") == 1 and width(b"\t" * 500) == most


def test_wide_records_and_broken_lines_as_before(spark, tmp_dir):
    _write_gz(f"{tmp_dir}/a.gz", b"a\tb\n1\t2\t\tx\n")
    with pytest.raises(ValueError, match="more fields"):
        TB.read_tables(spark, f"{tmp_dir}/a.gz").collect()
    _write_gz(f"{tmp_dir}/b.gz", b'a\tb\tc\n1\t"x\ny\tz\tz"\t3\n""\t5\t6\n')
    assert sorted(map(tuple, TB.read_tables(spark, f"{tmp_dir}/b.gz", infer=False).collect()), key=str) == [("1", "x\ny\tz\tz", "3"), (None, "5", "6")]


def test_text_files_follow_the_rows(spark, monkeypatch):
    """A gzip file is one task of its reader, so a sample must not be one file."""
    from cloudsift.plans import catalog
    monkeypatch.setattr(catalog, "ROWS_PER_TEXT_FILE", 100)
    monkeypatch.setattr(catalog, "_cache", {})
    n = B.cells(spark, SF_TINY).count()
    path = catalog._written(spark, SF_TINY, "by-sample")
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("p"), "file").distinct().groupBy("file").count().collect()
    assert len(files) == 3 and all(r["count"] > 1 for r in files)
    got = {r.file: r.n for r in catalog.q_row_counts(spark, SF_TINY).collect()}
    want = {r.sample: r["count"] for r in B.cells(spark, SF_TINY).groupBy("sample").count().collect()}
    assert got == {**want, None: n}


def test_line_files_follow_the_rows(spark, monkeypatch):
    from cloudsift.plans import catalog
    monkeypatch.setattr(catalog, "ROWS_PER_TEXT_FILE", 50)
    monkeypatch.setattr(catalog, "_cache", {})
    lines = spark.read.option("header", True).option("sep", "\t").csv(catalog._written(spark, SF_TINY, "lines"))
    parts = lines.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min(F.col("row_id").cast("long")).alias("a"), F.max(F.col("row_id").cast("long")).alias("b")).orderBy("f").collect()
    assert len(parts) > 8 and lines.count() == B.cells(spark, SF_TINY).count()
    assert all(p.b < q.a for p, q in zip(parts[:-1], parts[1:]))
