"""Extents and view fitting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.operators.ranks import visible_ordinal

# Fixed values of the viewer's camera fit.
FOV_DEG = 75.0
FIT_MARGIN = 1.1
DEPTH_FACTOR = 1.5
MIN_HEIGHT = 100.0
EXTENT_SAMPLE = 10_000  # fixed value: the viewer's sample; not a default here
HEAD_ROWS = 5


def bounding_box(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """min/max, centre, size per axis and the x-y extent (one row; no row
    values when the input is empty)."""
    aggs = []
    for a, c in (("x", x), ("y", y), ("z", z)):
        aggs += [F.min(c).alias(f"min_{a}"), F.max(c).alias(f"max_{a}")]
    box = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    cols = [F.col("n")]
    for a in "xyz":
        lo, hi = F.col(f"min_{a}"), F.col(f"max_{a}")
        cols += [lo, hi, ((lo + hi) * 0.5).alias(f"center_{a}"), (hi - lo).alias(f"size_{a}")]
    out = box.select(*cols)
    return out.withColumn("xy_extent", F.greatest(F.col("size_x"), F.col("size_y")))


def view_frame(box: DataFrame, fov_deg: float = FOV_DEG) -> DataFrame:
    """Camera above the centre, distance fitting the x-y extent."""
    tan_half = math.tan(math.radians(fov_deg) / 2)
    dist = (F.col("xy_extent") / 2) / F.lit(tan_half)
    height = F.greatest(dist * FIT_MARGIN, F.col("size_z") * DEPTH_FACTOR, F.lit(MIN_HEIGHT))
    return box.where(F.col("n") > 0).select(
        F.col("center_x").alias("target_x"), F.col("center_y").alias("target_y"),
        F.col("center_z").alias("target_z"), height.alias("height"),
        F.col("center_x").alias("pos_x"), F.col("center_y").alias("pos_y"),
        (F.col("center_z") + height).alias("pos_z"))


def _span_row(df: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for a in "xyz":
        aggs += [F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"),
                 (F.max(a) - F.min(a)).alias(f"span_{a}")]
    return df.agg(*aggs)


def extent_head(df: DataFrame, n: int | None = None, idx: str = "ordinal") -> DataFrame:
    """Min, max, span per axis over all rows, or over the first n in load
    order. ``idx`` is a dense 0-based load-order position (W5)."""
    return _span_row(df if n is None else df.where(F.col(idx) < n))


def stride_sample(df: DataFrame, target: int, idx: str = "row_idx") -> DataFrame:
    """Every s-th visible row in load order, s = max(1, floor(n / target))
    (at most 2 x target rows), with its ordinal. Only ``idx`` is ranked (one
    shuffle of one number per row); the sampled positions then pick their rows
    by a join. One plan at all sizes."""
    keys = visible_ordinal(df.select(idx), idx=idx, keep_total=True)
    step = F.greatest(F.lit(1), F.floor(F.col("n_rows") / target))
    wanted = keys.where(F.col("ordinal") % step == 0).drop("n_rows")
    return df.join(wanted, idx)


def extent_stride(df: DataFrame, target: int | None = None, idx: str = "row_idx") -> DataFrame:
    """A6 + A7 over the visible rows: exact by default (one partial
    aggregate), over the stride sample when a target is given."""
    return view_frame(bounding_box(df if target is None else stride_sample(df, target, idx)))


def head_rows(df: DataFrame, n: int = HEAD_ROWS, idx: str = "row_idx") -> DataFrame:
    """First n loaded rows (a bounded top-k, TakeOrderedAndProject)."""
    return df.orderBy(idx).limit(n)
