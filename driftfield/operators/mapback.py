"""Track numbers back on pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_assignment(series: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    """Per (frame, feature): the track numbers its pixels carry.

    A feature claimed by several tracks takes the highest one; within a track an
    attachment overrides nothing but fills the attached feature.
    """
    own = series.select(
        "frame_id", F.col("cloudnumber").alias("feature_id"), "track_id", "track_status",
        "merge_track", "split_track", F.lit("own").alias("kind"),
    )
    rows = own
    if attached is not None:
        clock = series.select("track_id", "time_idx", "frame_id")
        parts = attached.join(clock, ["track_id", "time_idx"]).select(
            "frame_id", F.col("cloudnumber").alias("feature_id"), "track_id", "kind"
        )
        rows = own.unionByName(parts, allowMissingColumns=True)

    mine = F.col("kind") == "own"

    def last(where, value: str):
        return F.max(F.when(where, F.struct("track_id", F.col(value).alias("v"))))["v"]

    return rows.groupBy("frame_id", "feature_id").agg(
        F.max(F.when(mine, F.col("track_id"))).alias("tracknumber"),
        last(mine, "track_status").alias("track_status"),
        last(mine & F.col("merge_track").isNotNull(), "merge_track").alias("merge_tracknumber"),
        last(mine & F.col("split_track").isNotNull(), "split_track").alias("split_tracknumber"),
        F.max("track_id").alias("cloudtracknumber"),
        F.max(F.when(F.col("kind") == "merge", F.col("track_id"))).alias("cloudmerge_tracknumber"),
        F.max(F.when(F.col("kind") == "split", F.col("track_id"))).alias("cloudsplit_tracknumber"),
    )


def map_tracks(
    labels: DataFrame,
    assignment: DataFrame,
    fields: DataFrame | None = None,
    rain_min: float | None = None,
    dbz_min: float | None = None,
) -> DataFrame:
    """Pixels with their track numbers; unclaimed pixels get 0.

    The rain and echo masks carry the track number only above their thresholds.
    They use the columns rain and dbz_comp of ``labels``, or of ``fields`` where
    the labels were made without them.
    """
    numbers = [c for c in assignment.columns if c.endswith("tracknumber")]
    out = labels.join(assignment, ["frame_id", "feature_id"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    if fields is not None:
        out = out.join(fields, ["frame_id", "y", "x"], "left")
    if rain_min is not None:
        out = out.withColumn(
            "pcptracknumber", F.when(F.col("rain") > rain_min, F.col("cloudtracknumber")).otherwise(0)
        )
    if dbz_min is not None:
        out = out.withColumn(
            "dbztracknumber", F.when(F.col("dbz_comp") > dbz_min, F.col("cloudtracknumber")).otherwise(0)
        )
    return out


def match_times(rows: DataFrame, frames: DataFrame, tolerance_s: float) -> DataFrame:
    """Tolerance join of row times to frame times: ``|base_time - epoch_s| < tolerance_s``.

    Both sides are bucketed by the tolerance, so it stays an equi-join; rows look
    into their own and the two neighbouring buckets.
    """
    probe = rows.withColumn(
        "_slot",
        F.explode(
            F.array(*[(F.floor(F.col("base_time") / tolerance_s) + k).cast("long") for k in (-1, 0, 1)])
        ),
    )
    build = frames.select(
        F.col("frame_id").alias("matched_frame"),
        F.col("epoch_s").alias("_t"),
        F.floor(F.col("epoch_s") / tolerance_s).cast("long").alias("_slot"),
    )
    return probe.join(build, "_slot").where(F.abs(F.col("base_time") - F.col("_t")) < tolerance_s).drop("_slot", "_t")
