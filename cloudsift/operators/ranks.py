"""Exact global positions without a one-partition sort.

All ranks here use the same plan shape ("two-level rank"):

1. a *bucket* that is a monotone prefix of the order key and spreads rows
   evenly (a hex prefix of an md5 key, or ``row_idx div width``);
2. ``groupBy(bucket).count()`` — partial aggregation, output bounded by the
   number of buckets;
3. a running sum over that small table gives each bucket's offset;
4. ``row_number()`` inside each bucket (one shuffle of the data, by bucket),
   plus the offset.

The bucket count is chosen from the row count so a bucket stays around a
million rows whatever the scale.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudsift.session import staged

ROWS_PER_BUCKET = 1 << 20
ROWS_PER_GROUP = 2_000_000  # rows per task of the permutation (and per written range)
_MAX_DIGITS = 5  # 16^5 buckets: the offsets table stays below ~1M rows (24 MB)
MAX_BROADCAST_SPLITS = 50_000  # file splits (a path and two numbers each, about 10 MB)


def _digits_for(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    need = max(1, math.ceil(n_rows / rows_per_bucket))
    return min(_MAX_DIGITS, max(2, math.ceil(math.log(need, 16)) if need > 1 else 2))


def bucket_offsets(bucketed: DataFrame, bucket: str) -> DataFrame:
    """(bucket, offset of its first row, total rows); size = number of buckets."""
    counts = bucketed.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        bucket,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_off"),
        F.sum("_n").over(Window.partitionBy()).cast("bigint").alias("n_rows"),
    )


def two_level_rank(df: DataFrame, bucket: Column, order: list[Column], out: str,
                   keep_total: bool = False, group_size: int | None = None,
                   n_groups: int | None = None) -> DataFrame:
    """Exact 0-based global rank of ``order`` (which must start with the order
    of ``bucket``) written to ``out``.

    With ``group_size`` (buckets per group) the one shuffle is on the group,
    a run of consecutive buckets: each task then holds whole contiguous rank
    ranges (good file layout downstream), and the window, partitioned by
    (group, bucket), needs no second exchange."""
    b = df.withColumn("_bkt", bucket)
    offsets = bucket_offsets(b, "_bkt")
    if group_size:
        b = b.withColumn("_grp", F.floor(F.col("_bkt") / group_size).cast("int"))
        b = b.repartitionById(n_groups, F.col("_grp"))
        within = Window.partitionBy("_grp", "_bkt").orderBy(*order)
    else:
        within = Window.partitionBy("_bkt").orderBy(*order)
    ranked = b.withColumn("_rn", F.row_number().over(within))
    # one row of three numbers per bucket of about a million rows: about 24 MB
    # at 10^12 rows, so it is broadcast and the ranked rows do not move again
    res = ranked.join(F.broadcast(offsets), "_bkt").withColumn(
        out, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
    drop = ["_bkt", "_rn", "_off", "_grp"] + ([] if keep_total else ["n_rows"])
    return res.drop(*[c for c in drop if c in res.columns])


ROWS_PER_RANGE = 200_000
MAX_RANGES = MAX_BROADCAST_SPLITS


def in_ranges(df: DataFrame, order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows in sampled ranges of ``order``, sorted and staged, with the
    number of their range (``_range``, in the order of the keys) and an id
    (``_at``) that is consecutive inside a range."""
    rows = staged(df, "to-rank")
    ranges = min(MAX_RANGES, max(1, math.ceil(rows.count() / rows_per_range)))
    return staged(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
                  .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ranges")


def range_rank(df: DataFrame, order: list[str], out: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Exact 0-based rank by ``order`` (columns that together are distinct),
    for keys of any distribution: values that share a long prefix spread like
    any others.

    Spark samples the keys and picks splitters at their quantiles; each range
    is sorted and written with its number and the consecutive ids of its rows,
    so the rank inside a range needs no window and stays as written however
    often a task runs again. The ranges' counts (at most ``MAX_RANGES`` rows,
    so they may be broadcast) give the offsets. No rows give no rows."""
    placed = in_ranges(df, order, rows_per_range)
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select("_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    return placed.join(F.broadcast(offsets), "_range").withColumn(out, (F.col("_off") + F.col("_at")).cast("bigint")).drop("_range", "_at", "_off")


def shuffle_key(key: str, seed: int, tiebreak: str | None = None) -> Column:
    """md5 of 'seed:key' (or 'seed:key:tiebreak'): the permutation order."""
    parts = [F.lit(f"{seed}:"), F.col(key).cast("string")]
    if tiebreak:
        parts += [F.lit(":"), F.col(tiebreak).cast("string")]
    return F.md5(F.concat(*parts))


def shuffle_rank(df: DataFrame, key: str, tiebreak: str | None = None, seed: int = 42,
                 digits: int | None = None, out: str = "row_idx", n_rows: int | None = None,
                 rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Seeded uniform permutation; ``row_idx`` 0..n-1 in the order of
    (md5(seed:key[:tiebreak]), tiebreak). Adds ``n_rows`` (the total) for W2.

    The tiebreak is hashed with the key, so copies of one key value (a group
    that may hold a large share of the rows) spread over all buckets instead
    of landing in one; (key, tiebreak) should be unique."""
    if n_rows is None:
        n_rows = df.count()
    if digits is None:
        digits = _digits_for(n_rows)
    k = shuffle_key(key, seed, tiebreak)
    bucket = F.conv(F.substring(k, 1, digits), 16, 10).cast("int")
    order = [F.col("_k")] + ([F.col(tiebreak)] if tiebreak else [])
    # tasks of about rows_per_group rows, each a run of consecutive buckets
    n_buckets = 16 ** digits
    n_groups = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / rows_per_group))
    n_groups = min(n_groups, n_buckets)
    group_size = math.ceil(n_buckets / n_groups)
    ranked = two_level_rank(df.withColumn("_k", k), bucket, order, out, keep_total=True,
                            group_size=group_size, n_groups=math.ceil(n_buckets / group_size))
    return ranked.drop("_k")


def _total(df: DataFrame, total_col: str) -> Column:
    if total_col in df.columns:
        return F.col(total_col)
    return df.select(F.count(F.lit(1))).scalar()


def assign_shards(df: DataFrame, n: int = 10, idx: str = "row_idx", total_col: str = "n_rows",
                  out: str = "shard") -> DataFrame:
    """N shards of floor(rows/n) rows; the last takes the remainder; fewer
    rows than shards puts every row in the last shard."""
    total = _total(df, total_col)
    per = F.floor(total / n).cast("bigint")
    shard = F.when(per == 0, F.lit(n)).otherwise(
        F.least(F.floor(F.col(idx) / per).cast("bigint"), F.lit(n - 1)) + 1)
    res = df.withColumn(out, shard.cast("int"))
    return res.drop(total_col) if total_col in df.columns else res


def assign_even_parts(df: DataFrame, n: int, idx: str = "row_idx", total_col: str = "n_rows",
                      out: str = "part") -> DataFrame:
    """N parts, the remainder spread one row each over the first parts
    (the assignment of ntile(n)), from arithmetic on a dense 0-based index."""
    total = _total(df, total_col)
    base = F.floor(total / n).cast("bigint")
    rem = (total - base * n).cast("bigint")
    big = rem * (base + 1)
    r = F.col(idx)
    part = (F.when(r < big, F.floor(r / (base + 1)))
            .otherwise(rem + F.floor((r - big) / F.when(base > 0, base).otherwise(F.lit(1)))) + 1)
    res = df.withColumn(out, part.cast("int"))
    return res.drop(total_col) if total_col in df.columns else res


def visible_ordinal(df: DataFrame, idx: str = "row_idx", out: str = "ordinal",
                    width: int = ROWS_PER_BUCKET, keep_total: bool = False) -> DataFrame:
    """Position of each (filtered) row in load order (``idx`` order)."""
    bucket = F.floor(F.col(idx) / width).cast("bigint")
    return two_level_rank(df, bucket, [F.col(idx)], out, keep_total=keep_total)


def line_number(df: DataFrame, out: str = "line", file_line: str | None = None,
                file_name: str | None = None) -> DataFrame:
    """Exact 0-based position of each line of a file-based read, input
    order kept (file path, then split start, then position inside the split);
    ``file_line`` also names the position inside its own file and
    ``file_name`` the file's name.

    The read happens once: lines are staged in the shared folder with their
    (file, split) and ``monotonically_increasing_id``, which is consecutive
    inside a split. The per-split counts come from the staged copy; they are
    broadcast only when counted to be few, else joined by a shuffle."""
    extra = [F.col("_metadata.file_name").alias(file_name)] if file_name else []
    md = staged(df.select("*", *extra, F.col("_metadata.file_path").alias("_fp"),
                          F.col("_metadata.file_block_start").alias("_fs"),
                          F.monotonically_increasing_id().alias("_mid")), "lines")
    splits = staged(md.groupBy("_fp", "_fs").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")), "splits")
    # positions: inside each file, then of the files
    in_file = Window.partitionBy("_fp").orderBy("_fs").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("_fp").agg(F.sum("_n").alias("_fn"))
    before = Window.orderBy("_fp").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_fp", F.coalesce(F.sum("_fn").over(before), F.lit(0)).alias("_at"))     # one row per file
    offsets = splits.select("_fp", "_fs", "_m0", F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_foff")).join(starts, "_fp")
    few = splits.count() <= MAX_BROADCAST_SPLITS
    res = md.join(F.broadcast(offsets) if few else offsets, ["_fp", "_fs"])
    at = F.col("_foff") + F.col("_mid") - F.col("_m0")
    res = res.withColumn(out, (F.col("_at") + at).cast("bigint"))
    if file_line:
        res = res.withColumn(file_line, at.cast("bigint"))
    return res.drop("_fp", "_fs", "_mid", "_m0", "_at", "_foff")
