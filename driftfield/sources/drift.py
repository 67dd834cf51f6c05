"""Domain motion matched to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_drift(frames: DataFrame, drift: DataFrame, time: str = "ts") -> DataFrame:
    """(frame_id, dy, dx): the shift of each frame's time.

    A time without a shift, or with several, is not moved.
    """
    once = (
        drift.groupBy(time)
        .agg(F.count(F.lit(1)).alias("_n"), F.first("dy").alias("dy"), F.first("dx").alias("dx"))
        .where("_n = 1")
    )
    return frames.join(once, time, "left").select(
        "frame_id", F.coalesce("dy", F.lit(0)).cast("int").alias("dy"), F.coalesce("dx", F.lit(0)).cast("int").alias("dx")
    )
