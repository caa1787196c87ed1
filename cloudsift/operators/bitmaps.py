"""A bitmap index for filter lists (F3, F8): built once per dataset, it answers
a conjunctive filter list, its rows and its funnel without reading the
attribute columns again.

* Categoricals: one bitmap over ``row_idx`` per (shard, attribute, value,
  bucket of 32 768 rows); a value set is the OR of its bitmaps.
* Numbers: a copy of each continuous column sorted by value, so a range reads
  only the row groups it touches and turns the rows found into bitmaps.
* The list is the AND of its filters' bitmaps per bucket, the funnel the
  popcounts of the running ANDs. Buckets are the only key that moves, 4 KB
  each, so a value that holds a third of the rows weighs no more than another.

Null and '' are one categorical value; a null number is in no range. An
attribute with more than ``MAX_VALUES`` values is not indexed (its filters use
the column, ``filter_all``). An empty dataset gives an empty index, no rows
and a funnel of zeros.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.operators.filters import FilterSpec, norm_category
from cloudsift.operators.profile import attribute_domain, clean_number
from cloudsift.roles import Roles
from cloudsift.session import shared_dir, staged

MAX_VALUES = 10_000
BUCKET = 32_768                 # bits of Spark's bitmaps
ROWS_PER_RANGE = 2_000_000      # rows of a sorted number file
ROWS_PER_TASK = 500_000         # rows that a task turns into bitmaps


_SCHEMA = {"rows": "shard int, bucket bigint, bits binary", "values": "shard int, value string, bucket bigint, bits binary, attribute string",
           "numbers": "shard int, row_idx bigint, value double, attribute string"}


@dataclass(frozen=True)
class BitmapIndex:
    spark: SparkSession
    path: str
    categorical: tuple[str, ...]
    continuous: tuple[str, ...]
    tasks: int = 2                  # that turn all rows into bitmaps

    def read(self, part: str, shards: int | None = None) -> DataFrame:
        df = self.spark.read.schema(_SCHEMA[part]).parquet(f"{self.path}/{part}")
        return df if shards is None else df.where(F.col("shard") <= shards)


def _position(idx: str = "row_idx"):
    """Spark's bitmaps number bits from 1."""
    return F.col(idx) + 1


def build_index(df: DataFrame, roles: Roles, path: str | None = None, max_values: int = MAX_VALUES) -> BitmapIndex:
    """Index of the dataset ``df`` (with ``row_idx`` and ``shard``). Its
    columns are staged and scanned three times.

    A bucket's rows first meet in one task, whatever order ``df`` has: where
    they lie in many, each of these would make bitmaps of 4 KB for nearly every
    bucket and value. The tasks follow the number of rows, so what one of them
    sorts does not grow with the table."""
    spark = df.sparkSession
    path = path or shared_dir(spark, "bitmaps")
    present = tuple(a for a in roles.categorical if a in df.columns)
    continuous = tuple(a for a in roles.continuous if a in df.columns)
    df = staged(df.select("shard", "row_idx", *present, *(a for a in continuous if a not in present)), "to-index")
    sizes = attribute_domain(df, roles, present).groupBy("attribute").count().where(F.col("count") > max_values).collect() if present else []
    categorical = tuple(a for a in present if a not in {r.attribute for r in sizes})
    n_rows = df.count()
    index = BitmapIndex(spark, path, categorical, continuous, max(2, math.ceil(n_rows / ROWS_PER_TASK)))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(_position())).alias("bits")
    met = _by_bucket(df, index.tasks)
    met.groupBy("shard", "bucket").agg(bits).write.mode("overwrite").parquet(f"{path}/rows")
    if categorical:
        pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), norm_category(F.col(a)).alias("value")) for a in categorical))
        (met.select("shard", "row_idx", "bucket", F.inline(pairs)).groupBy("shard", "attribute", "value", "bucket").agg(bits)
         .write.mode("overwrite").partitionBy("attribute").parquet(f"{path}/values"))
    if continuous:
        pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), clean_number(F.col(a)).alias("value")) for a in continuous))
        numbers = df.select("shard", "row_idx", F.inline(pairs)).where(F.col("value").isNotNull())
        files = max(1, math.ceil(n_rows * len(continuous) / ROWS_PER_RANGE))
        # a value that fills more than one range is dealt on by row_idx
        (numbers.repartitionByRange(files, "attribute", "value", "row_idx").sortWithinPartitions("attribute", "value")
         .write.mode("overwrite").partitionBy("attribute").parquet(f"{path}/numbers"))
    return index


def _by_bucket(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` with its ``bucket``, dealt to ``tasks`` tasks by it."""
    return df.withColumn("bucket", F.bitmap_bucket_number(_position())).repartition(tasks, "bucket")


def _one(index: BitmapIndex, spec: FilterSpec, shards: int | None) -> DataFrame:
    """(bucket, bits) of the rows that one active filter keeps."""
    if spec.type == "categorical":
        if spec.attribute not in index.categorical:
            raise KeyError(f"{spec.attribute} is not indexed: filter by its column")
        if spec.whole is not None:
            raise KeyError("a filter on all values has no list to look up: filter by its column")
        found = index.read("values", shards).where((F.col("attribute") == spec.attribute) & F.col("value").isin(list(spec.values)))
        return found.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    if spec.attribute not in index.continuous:
        raise KeyError(f"{spec.attribute} is not indexed: filter by its column")
    found = index.read("numbers", shards).where((F.col("attribute") == spec.attribute) & F.col("value").between(*map(float, spec.range)))
    return _by_bucket(found.select("row_idx"), index.tasks).groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(_position())).alias("bits"))


def _steps(index: BitmapIndex, specs: list[FilterSpec], shards: int | None) -> DataFrame:
    """(step, bucket, bits): step 0 all rows, step i the i-th active filter."""
    out = index.read("rows", shards).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).select(F.lit(0).alias("step"), "bucket", "bits")
    for i, spec in enumerate([s for s in specs if s.is_active()], 1):
        out = out.unionAll(_one(index, spec, shards).select(F.lit(i).alias("step"), "bucket", "bits"))
    return out


def filter_bitmaps(index: BitmapIndex, specs: list[FilterSpec], shards: int | None = None) -> DataFrame:
    """(bucket, bits) of the rows that pass the whole list."""
    active = sum(s.is_active() for s in specs)
    both = _steps(index, specs, shards).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where(F.col("n") == active + 1).select("bucket", "bits")


def bitmap_rows(bitmaps: DataFrame, idx: str = "row_idx") -> DataFrame:
    """The row numbers of (bucket, bits): 32 bits at a time, words without a
    bit dropped before their bits are listed."""
    word = lambda i: F.conv(F.hex(F.substring(F.col("bits"), i * 4 + 1, F.lit(4))), 16, 10).cast("bigint")
    words = bitmaps.select("bucket", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 32 - 1)), word)).alias("i", "w")).where(F.col("w") > 0)
    # bit t stands in byte t div 8 of the word (the first byte is its highest), lowest bit first
    shift = lambda t: F.lit(24) - (t - t % 8) + t % 8
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda t: F.call_function("shiftright", F.col("w"), shift(t)).bitwiseAND(F.lit(1)) == 1)
    return words.select("bucket", "i", F.explode(set_bits).alias("t")).select(((F.col("bucket") - 1) * BUCKET + F.col("i") * 32 + F.col("t")).cast("bigint").alias(idx))


def bitmap_filter(index: BitmapIndex, specs: list[FilterSpec], shards: int | None = None) -> DataFrame:
    """``row_idx`` of the rows that pass the whole list."""
    return bitmap_rows(filter_bitmaps(index, specs, shards))


def bitmap_funnel(index: BitmapIndex, specs: list[FilterSpec], shards: int | None = None) -> DataFrame:
    """F8 from popcounts: the rows of ``filter_funnel``."""
    active = [s.is_active() for s in specs]
    last = sum(active)
    per = _steps(index, specs, shards).groupBy("bucket").agg(*(
        F.when(F.count(F.when(F.col("step") <= k, 1)) == k + 1, F.bitmap_count(F.bitmap_and_agg(F.when(F.col("step") <= k, F.col("bits")))))
        .otherwise(F.lit(0)).alias(f"n{k}") for k in range(last + 1)))
    counts = per.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)).cast("bigint").alias(f"n{k}") for k in range(last + 1)))
    line = lambda step, name, on, a, b: F.struct(F.lit(step).alias("step"), F.lit(name).alias("attribute"), F.lit(on).alias("applied"),
                                                 F.col(f"n{a}").alias("n_before"), F.col(f"n{b}").alias("n_after"))
    rows = [line(0, "(all)", True, 0, last)]
    for i, s in enumerate(specs):
        before = sum(active[:i])
        rows.append(line(i + 1, s.attribute or "", active[i], before, before + active[i]))
    return counts.select(F.inline(F.array(*rows)))
