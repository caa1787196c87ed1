"""Header-preserving text split."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.functions.text import part_name
from cloudsift.operators.ranks import assign_even_parts, line_number, visible_ordinal
from cloudsift.sources.tables import list_inputs

PART_LIMIT_BYTES = 100 * 1024 * 1024  # fixed value: 100 MiB warning limit


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def parts_for_limit(spark: SparkSession, path: str, limit_bytes: int = PART_LIMIT_BYTES) -> int:
    """Parts needed so each gzip part stays under the limit, estimated from
    the gzipped source size (same codec in and out). This also bounds the
    work of each writing task."""
    total = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return max(1, -(-int(total) // limit_bytes))


def split_with_header(spark: SparkSession, path: str, out: str, n: int, rename: bool = True,
                      every_file_has_header: bool = False) -> list[str]:
    """Keep line order, n near-equal parts (the first rows % n parts one
    line longer), the header repeated at the top of each part, gzip output
    named '<base>.partNN<ext>'. Bad UTF-8 becomes U+FFFD.

    ``path`` may name several files: they are one text, in order of their
    names, whose first line is the header; with ``every_file_has_header`` the
    first line of each later file is dropped. Each part is one gzip file, so
    one task writes it: choose n so a part stays near the 100 MiB the source
    warns about (``parts_for_limit``)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    files = list_inputs(spark, path)
    raw = spark.read.format("text").option("wholetext", False).load(files)
    numbered = line_number(raw.select(F.make_valid_utf8(F.col("value")).alias("value")), file_line="file_line")
    header = numbered.where(F.col("line") == 0).select("value").first()      # one line
    if header is None:
        raise ValueError("input file is empty")
    data = numbered.where(F.col("line") > 0)
    if every_file_has_header and len(files) > 1:
        data = visible_ordinal(data.where(F.col("file_line") > 0), idx="line", out="row_idx")
    else:
        data = data.withColumn("row_idx", F.col("line") - 1)
    data = assign_even_parts(data, n).select("part", F.col("row_idx").alias("pos"), "value")
    heads = spark.range(1, n + 1).select(F.col("id").cast("int").alias("part"),
                                         F.lit(-1).cast("bigint").alias("pos"),
                                         F.lit(header.value).alias("value"))
    lines = heads.unionByName(data)
    (lines.repartitionById(n, F.col("part") - 1).sortWithinPartitions("part", "pos").select("part", "value")
     .write.mode("overwrite").partitionBy("part").option("compression", "gzip").option("maxRecordsPerFile", 0).text(out))
    if not rename:
        return [f"{out}/part={i}" for i in range(1, n + 1)]
    return _rename_parts(spark, files[0], out, n)


def _rename_parts(spark: SparkSession, source: str, out: str, n: int) -> list[str]:
    """X8 naming as a final metadata-only rename of one file per part (a few
    at a time). Nothing is deleted unless it is empty: a part that is not
    exactly one file, or a rename that fails, raises and leaves all files."""
    names = (spark.range(1, n + 1).select(F.col("id").cast("int").alias("i"),
                                          part_name(F.lit(source), F.col("id")).alias("name"))
             .orderBy("i").collect())
    fs, jvm = _hadoop_fs(spark, out)
    Path = jvm.org.apache.hadoop.fs.Path

    def move(row) -> str:
        folder = Path(f"{out}/part={row.i}")
        found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".gz")]
        if len(found) != 1:
            raise OSError(f"part {row.i} has {len(found)} files, not one: {folder}")
        target = Path(f"{out}/{row.name}")
        if not fs.rename(found[0], target):
            raise OSError(f"cannot rename {found[0]} to {target}")
        if all(s.getPath().getName().startswith(".") for s in fs.listStatus(folder)):
            fs.delete(folder, True)
        return str(target.toString())

    with ThreadPoolExecutor(max_workers=16) as pool:
        return list(pool.map(move, names))


def read_parts(spark: SparkSession, out: str, pattern: str = "*.gz") -> DataFrame:
    """Lines of the written parts with (file, line) positions."""
    df = spark.read.text(f"{out.rstrip('/')}/{pattern}")
    return line_number(df.withColumn("file", F.col("_metadata.file_name"))).withColumnRenamed("line", "g")


def part_report(spark: SparkSession, out: str, pattern: str = "*.gz") -> DataFrame:
    """Parts, average, largest, smallest MiB, any over 100 MiB."""
    sizes = spark.read.format("binaryFile").load(f"{out.rstrip('/')}/{pattern}").select("length")
    mib = F.col("length") / (1024 * 1024)
    return sizes.agg(F.count(F.lit(1)).alias("parts"), F.avg(mib).alias("avg_mib"),
                     F.max(mib).alias("max_mib"), F.min(mib).alias("min_mib"),
                     F.bool_or(F.col("length") > PART_LIMIT_BYTES).alias("any_over_limit"))
