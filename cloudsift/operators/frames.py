"""Time-rank frames (A13, W4, O2; F7 is in filters).

A frame key is a smallint, so the frame table has at most 65 536 rows: its
one-partition window is bounded by the type, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_value(frame_key: str):
    """Null rank is frame 0 (values are read after null → 0)."""
    return F.coalesce(F.col(frame_key).cast("int"), F.lit(0))


def frame_counts(df: DataFrame, frame_key: str) -> DataFrame:
    """Points per time rank — all animation frames in one job."""
    return df.groupBy(frame_value(frame_key).alias("time_rank")).agg(F.count(F.lit(1)).alias("n"))


def sorted_frames(df: DataFrame, frame_key: str) -> DataFrame:
    """O2: distinct ranks in numeric order."""
    return df.select(frame_value(frame_key).alias("time_rank")).distinct().orderBy("time_rank")


def frame_index(df: DataFrame, frame_key: str) -> DataFrame:
    """(frame_idx 0-based, time_rank, n_frames, label, next_idx cyclic)."""
    frames = df.select(frame_value(frame_key).alias("time_rank")).distinct()
    w = Window.orderBy("time_rank")
    f = frames.select("time_rank", (F.row_number().over(w) - 1).alias("frame_idx"),
                      F.count(F.lit(1)).over(Window.partitionBy()).alias("n_frames"))
    return f.select(
        F.col("frame_idx").cast("int").alias("frame_idx"), "time_rank",
        F.col("n_frames").cast("int").alias("n_frames"),
        F.format_string("TimeRank: %d (%d/%d)", F.col("time_rank"), F.col("frame_idx") + 1,
                        F.col("n_frames")).alias("label"),
        ((F.col("frame_idx") + 1) % F.col("n_frames")).cast("int").alias("next_idx"))


def frame_at(frames: DataFrame, index: int) -> DataFrame:
    """The frame at an index; an index outside 0..n-1 gives no row (ignored)."""
    return frames.where(F.col("frame_idx") == index)
