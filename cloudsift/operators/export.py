"""Render set (O3) and render-ready export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.operators.palette import color_encode
from cloudsift.operators.project import map_axes
from cloudsift.operators.ranks import ROWS_PER_BUCKET, bucket_offsets, visible_ordinal
from cloudsift.roles import Roles

MAX_POINTS = 8_000_000  # fixed value: the viewer's render cap; not a default here


def render_cap(visible: DataFrame, cap: int | None = None, idx: str = "row_idx",
               width: int = ROWS_PER_BUCKET) -> DataFrame:
    """O3: visible rows in load order with their ordinal (W5): all of them, or
    the first ``cap``. With a cap, buckets of ``width`` row_idx values are
    counted first; the last bucket that starts below the cap is one scalar,
    so the cut is a plain filter on row_idx (it reaches the scan) and at most
    cap + width rows are shuffled."""
    if cap is None:
        return visible_ordinal(visible, idx=idx, width=width)
    bucket = F.floor(F.col(idx) / width).cast("bigint")
    starts = bucket_offsets(visible.select(bucket.alias("_bkt")), "_bkt")
    last = starts.where(F.col("_off") < cap).agg(F.max("_bkt")).scalar()
    kept = visible.where(F.col(idx) < (last + 1) * width)
    return visible_ordinal(kept, idx=idx, width=width).where(F.col("ordinal") < cap)


def render_table(visible: DataFrame, roles: Roles, color_by: str, ranges: DataFrame | None = None,
                 palette: DataFrame | None = None, axes=(None, None, None),
                 cap: int | None = None) -> DataFrame:
    """(row_idx, ordinal, x, y, z float32, r, g, b 8-bit): what the GPU draws."""
    # cap first: the ordinal's count pass then reads only row_idx, and only
    # rendered rows reach the colour join
    needed = ["row_idx", color_by] + [c for c in roles.coords if c in visible.columns]
    capped = render_cap(visible.select(*dict.fromkeys(needed)), cap)
    mapped = map_axes(capped, roles, *axes)
    coloured = color_encode(mapped, color_by, roles, ranges=ranges, palette=palette)
    return coloured.select(
        "row_idx", "ordinal", *(F.col(a).cast("float").alias(a) for a in "xyz"),
        *(F.col(c).cast("int").alias(c) for c in "rgb"))


def export_points(table: DataFrame, path: str) -> str:
    """Write the render-ready table as Parquet (zstd)."""
    table.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path
