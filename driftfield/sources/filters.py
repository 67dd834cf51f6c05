"""Selections on frames and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_range(df: DataFrame, start, end, time: str = "ts") -> DataFrame:
    """Both ends inclusive; prunes partitions when ``time`` is a partition column."""
    return df.where(F.col(time).between(start, end))


def start_end(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.agg(F.min(time).alias("start"), F.max(time).alias("end"))


def hourly_frames(df: DataFrame, minute: int, tolerance: float, time: str = "ts") -> DataFrame:
    return df.where(F.abs(F.minute(time) - minute) < tolerance)


def open_interval(value: Column | str, low: float, high: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return (value > low) & (value < high)


def box_hull(df: DataFrame, grid: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Pixels in the index rectangle spanned by the grid cells inside a lat/lon box.

    The four limits are scalar subqueries, so the pixels are only filtered.
    """
    inside = grid.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))

    def limit(fn, col: str) -> Column:
        return inside.agg(fn(col)).scalar()

    return df.where(
        F.col("y").between(limit(F.min, "y"), limit(F.max, "y")) & F.col("x").between(limit(F.min, "x"), limit(F.max, "x"))
    )


def complete_frames(df: DataFrame, value: str, cells: int, max_missing: float) -> DataFrame:
    """Frames whose share of missing cells stays below the limit."""
    present = df.groupBy("frame_id").agg(F.count(value).alias("_n"))
    good = present.where((F.lit(cells) - F.col("_n")) / cells < max_missing).select("frame_id")
    return df.join(good, "frame_id", "left_semi")


def common_times(left: DataFrame, right: DataFrame, time: str = "ts") -> DataFrame:
    return left.join(right.select(time).distinct(), time, "left_semi")
