"""Overlap links between features of adjacent frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_pairs(frames: DataFrame, timegap_h: float, lag: int = 1) -> DataFrame:
    """Adjacent frames with ``0 < hours apart < timegap_h``: (frame_id, next_frame, dt_h)."""
    later = frames.select(
        (F.col("frame_id") - lag).alias("frame_id"),
        F.col("frame_id").alias("next_frame"),
        F.col("epoch_s").alias("_next"),
    )
    return (
        frames.join(later, "frame_id")
        .withColumn("dt_h", (F.col("_next") - F.col("epoch_s")) / F.lit(3600.0))
        .where((F.col("dt_h") > 0) & (F.col("dt_h") < timegap_h))
        .select("frame_id", "next_frame", "dt_h")
    )


def shift_labels(labels: DataFrame, drift: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Move each frame's labels by its (dy, dx); pixels leaving the grid are dropped."""
    ny, nx = shape
    return (
        labels.join(drift.select("frame_id", "dy", "dx"), "frame_id", "left")
        .withColumns(
            {
                "y": (F.col("y") + F.coalesce("dy", F.lit(0))).cast("int"),
                "x": (F.col("x") + F.coalesce("dx", F.lit(0))).cast("int"),
            }
        )
        .where(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1))
        .drop("dy", "dx")
    )


def overlap_links(
    labels: DataFrame,
    pairs: DataFrame,
    othresh: float,
    drift: DataFrame | None = None,
    shape: tuple[int, int] | None = None,
    features: DataFrame | None = None,
) -> DataFrame:
    """Links whose overlap exceeds ``othresh`` of either feature (both tests strict).

    One equi-join on (frame, y, x) yields both directions.  The join key is
    unique per pixel, so the shuffle is even however unequal frames or features
    are; counts are pre-aggregated before they move.  Feature sizes come from
    ``features`` (npix) where given, else from the labels; shifted labels are
    counted again, because pixels may have left the grid.
    """
    px = labels.select("frame_id", "y", "x", "feature_id")
    ref = shift_labels(px, drift, shape) if drift is not None else px

    def sizes(of: DataFrame, name: str, known: bool) -> DataFrame:
        if known:
            return features.select("frame_id", "feature_id", F.col("npix").alias(name))
        return of.groupBy("frame_id", "feature_id").agg(F.count(F.lit(1)).alias(name))

    ref_px = sizes(ref, "ref_px", features is not None and drift is None)
    new_px = sizes(px, "new_px", features is not None)
    steps = pairs.select("frame_id", "next_frame")
    left = ref.join(steps, "frame_id").select(
        F.col("frame_id").alias("ref_frame"),
        F.col("next_frame").alias("new_frame"),
        "y",
        "x",
        F.col("feature_id").alias("ref_id"),
    )
    right = px.select(
        F.col("frame_id").alias("new_frame"), "y", "x", F.col("feature_id").alias("new_id")
    )
    overlap = (
        left.join(right, ["new_frame", "y", "x"])
        .groupBy("ref_frame", "ref_id", "new_frame", "new_id")
        .agg(F.count(F.lit(1)).alias("overlap_px"))
    )
    return (
        overlap.join(
            ref_px.withColumnsRenamed({"frame_id": "ref_frame", "feature_id": "ref_id"}),
            ["ref_frame", "ref_id"],
        )
        .join(
            new_px.withColumnsRenamed({"frame_id": "new_frame", "feature_id": "new_id"}),
            ["new_frame", "new_id"],
        )
        .withColumns(
            {
                "is_fwd": F.col("overlap_px") / F.col("ref_px") > othresh,
                "is_bwd": F.col("overlap_px") / F.col("new_px") > othresh,
            }
        )
        .where("is_fwd or is_bwd")
        .select(
            "ref_frame", "ref_id", "new_frame", "new_id",
            "overlap_px", "ref_px", "new_px", "is_fwd", "is_bwd",
        )
    )
