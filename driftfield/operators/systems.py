"""Selecting long-lived systems from track series: gaps and islands per track.

A track has one row per frame, so the per-track windows below are bounded by the
number of frames; the row data themselves never concentrate in a track.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: Sequence[str], index: str, gap: int, out: str = "island") -> DataFrame:
    """Number the runs of ``index`` whose steps are at most ``gap``."""
    w = Window.partitionBy(*keys).orderBy(index)
    opens = F.when(F.col(index) - F.lag(index).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_open", opens).withColumn(out, F.sum("_open").over(w)).drop("_open")


def _span(w, index: str, dt_h: float) -> Column:
    return (F.max(index).over(w) - F.min(index).over(w) + 1) * dt_h


def cold_systems(
    series: DataFrame, area_thresh: float, min_hours: float, gap: int, dt_h: float
) -> DataFrame:
    """Tracks with a cold core whose shield stays above the area threshold long enough.

    One row per selected track: track_id, mcs_duration (number of qualifying times).
    """
    shield = F.col("core_area") + F.col("cold_area")
    large = islands(series.where(shield > area_thresh), ["track_id"], "time_idx", gap)
    periods = (
        large.groupBy("track_id", "island")
        .agg(
            ((F.max("time_idx") - F.min("time_idx") + 1) * dt_h).alias("hours"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("hours") >= min_hours)
        .groupBy("track_id")
        .agg(F.sum("n").alias("mcs_duration"))
    )
    cored = series.where("core_area > 0").select("track_id").distinct()
    return periods.join(cored, "track_id", "left_semi")


def system_series(series: DataFrame, systems: DataFrame, area_thresh: float) -> DataFrame:
    """Rows of the selected tracks with shield area and status (1 large, 0 smaller)."""
    shield = F.col("core_area") + F.col("cold_area")
    return series.join(systems, "track_id").withColumns(
        {
            "ccs_area": shield,
            "mcs_status": F.when(shield > area_thresh, 1).when(shield > 0, 0),
        }
    )


def main_tracks(series: DataFrame, ends: DataFrame, min_hours: float, min_max_area: float, dt_h: float) -> DataFrame:
    """Tracks that last and grow enough (both tests inclusive)."""
    grown = series.groupBy("track_id").agg(F.max("area").alias("max_area")).where(F.col("max_area") >= min_max_area)
    return grown.join(ends.where(F.col("track_duration") * dt_h >= min_hours), "track_id").select(
        "track_id", "track_duration", "max_area"
    )


def attachments(
    series: DataFrame,
    ends: DataFrame,
    systems: DataFrame,
    merge_hours: float,
    split_hours: float,
    dt_h: float,
    value: Column,
    slots: int | None = None,
) -> DataFrame:
    """Short tracks merging into or splitting from a system, at the system's times.

    Rows: track_id (system), time_idx, base_time, kind, slot, part_track,
    cloudnumber, part_status, part_area.  ``slots`` keeps the first attachments of
    a time, as a fixed-width output would; by default all are kept.
    """
    ids = systems.select("track_id")
    minor = ends.join(ids, "track_id", "left_anti")
    hours = F.col("track_duration") * dt_h
    links = minor.where(hours < merge_hours).select(
        F.col("end_merge_tracknumber").alias("_main"), "track_id", F.lit("merge").alias("kind")
    ).unionByName(
        minor.where(hours < split_hours).select(
            F.col("start_split_tracknumber").alias("_main"), "track_id", F.lit("split").alias("kind")
        )
    ).where("_main is not null").join(ids.withColumnRenamed("track_id", "_main"), "_main", "left_semi")
    parts = series.join(links, "track_id").select(
        "_main", "kind", "base_time",
        F.col("track_id").alias("part_track"),
        F.col("time_idx").alias("_pidx"),
        "cloudnumber",
        F.col("track_status").alias("part_status"),
        value.alias("part_area"),
    )
    clock = series.join(ids, "track_id", "left_semi").select(
        F.col("track_id").alias("_main"), "base_time", "time_idx"
    )
    order = Window.partitionBy("_main", "kind", "base_time").orderBy("part_track", "_pidx")
    out = (
        parts.join(clock, ["_main", "base_time"])
        .withColumn("slot", F.row_number().over(order))
        .withColumnRenamed("_main", "track_id")
        .drop("_pidx")
    )
    return out.where(F.col("slot") <= slots) if slots else out


def _periods(rows: DataFrame, candidate: Column, min_hours: float, gap: int, dt_h: float) -> DataFrame:
    """Candidate times in long enough islands of tracks with enough candidate times in all."""
    track = Window.partitionBy("track_id")
    cand = rows.where(candidate).withColumn("_all", F.count(F.lit(1)).over(track) * dt_h)
    cand = islands(cand.where(F.col("_all") > min_hours), ["track_id"], "time_idx", gap)
    island = Window.partitionBy("track_id", "island")
    return cand.withColumn("period_h", _span(island, "time_idx", dt_h)).where(F.col("period_h") >= min_hours).drop("_all")


def robust_by_rain(
    rows: DataFrame,
    axis_range: tuple[float, float],
    min_hours: float,
    gap: int,
    dt_h: float,
    area: Sequence[float],
    rate: Sequence[float],
    skew: Sequence[float],
    heavy: Sequence[float],
) -> DataFrame:
    """Times of periods whose largest rain feature meets duration-dependent thresholds.

    ``rows``: track_id, time_idx, pf_majoraxis, pf_area, pf_rainrate, pf_skewness
    (largest feature) and total_volrain, total_heavyvolrain.  Threshold pairs are
    (constant, per hour of period).  Returns track_id, time_idx, period_h.
    """
    lo, hi = axis_range
    cand = _periods(rows, F.col("pf_majoraxis").between(lo, hi), min_hours, gap, dt_h)

    def limit(pair: Sequence[float]) -> Column:
        return F.lit(float(pair[0])) + F.lit(float(pair[1])) * F.col("period_h")

    strong = (
        (F.col("pf_area") > limit(area))
        & (F.col("pf_rainrate") > limit(rate))
        & (F.col("pf_skewness") > limit(skew))
    )
    island = Window.partitionBy("track_id", "island")
    ratio = F.lit(100.0) * F.sum("total_heavyvolrain").over(island) / F.sum("total_volrain").over(island)
    return (
        cand.withColumns(
            {
                "_strong": F.sum(strong.cast("int")).over(island) * dt_h,
                "_ratio": ratio,
            }
        )
        .where((F.col("_strong") >= min_hours) & (F.col("_ratio") > limit(heavy)))
        .select("track_id", "time_idx", "period_h")
    )


def robust_by_volume(
    rows: DataFrame,
    axis_range: tuple[float, float],
    min_hours: float,
    gap: int,
    dt_h: float,
    heavy_rate: float,
    min_volume: float,
    min_volume_hours: float,
) -> DataFrame:
    """Variant with peak rain rate and rain volume durations (pf_maxrainrate, total_volrain)."""
    lo, hi = axis_range
    cand = _periods(rows, F.col("pf_majoraxis").between(lo, hi), min_hours, gap, dt_h)
    island = Window.partitionBy("track_id", "island")
    return (
        cand.withColumns(
            {
                "_peak": F.sum((F.col("pf_maxrainrate") > heavy_rate).cast("int")).over(island) * dt_h,
                "_vol": F.sum((F.col("total_volrain") > min_volume).cast("int")).over(island) * dt_h,
            }
        )
        .where((F.col("_peak") >= min_hours) & (F.col("_vol") >= min_volume_hours))
        .select("track_id", "time_idx", "period_h")
    )


def robust_by_radar(rows: DataFrame, min_axis: float, min_hours: float, gap: int, dt_h: float) -> DataFrame:
    """Variant with a long feature that contains strong echo (pf_majoraxis, pf_cc45area)."""
    cand = (F.col("pf_majoraxis") >= min_axis) & (F.col("pf_cc45area") > 0)
    return _periods(rows, cand, min_hours, gap, dt_h).select("track_id", "time_idx", "period_h")


def feature_lifetime(features: DataFrame, axis: float, dt_h: float) -> DataFrame:
    """Hours during which the longest of a track's rain features exceeds ``axis``."""
    longest = features.groupBy("track_id", "time_idx").agg(F.max("pf_majoraxis").alias("_a"))
    return longest.groupBy("track_id").agg(
        (F.sum((F.col("_a") > axis).cast("int")) * dt_h).alias("pf_lifetime")
    )


def _longest_run(rows: DataFrame, flag: Column, name: str, gap: int = 2) -> DataFrame:
    """First, second and last time of the longest run of flagged times per track.

    A single run is filled: its times count from first to last without a break.
    """
    runs = (
        islands(rows.where(flag), ["track_id"], "time_idx", gap)
        .groupBy("track_id", "island")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("time_idx").alias("first"),
            F.max("time_idx").alias("last"),
            F.sort_array(F.collect_list("time_idx")).alias("times"),
        )
    )
    best = runs.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.max(F.struct("n", (-F.col("island")).alias("_i"), "first", "last", "times")).alias("r"),
    )
    filled = F.col("runs") == 1
    return best.select(
        "track_id",
        F.col("r.first").alias(f"{name}_first"),
        F.col("r.last").alias(f"{name}_last"),
        F.when(filled, F.sequence(F.col("r.first"), F.col("r.last"))).otherwise(F.col("r.times")).alias(f"{name}_times"),
    )


def life_cycle(rows: DataFrame, min_hours: float, dt_h: float, line_km: float = 100.0) -> DataFrame:
    """Stage (1 cloud only, 2 cells, 3 organising, 4 mature, 5 decay) of each time.

    ``rows``: track_id, time_idx, core_area (largest core), core_axis (longest
    core), sf_area (summed stratiform area).  Returns track_id, time_idx,
    cycle_stage (NULL when undefined) and cycle_complete (1 with four stages).
    """
    track = Window.partitionBy("track_id")
    rows = rows.withColumns(
        {"_len": F.max("time_idx").over(track) + 1, "_sf": F.avg("sf_area").over(track)}
    ).where(F.col("_len") * dt_h >= min_hours)
    line = F.col("core_axis") > line_km
    cc = _longest_run(rows, F.col("core_area") > 0, "cc")
    ln = _longest_run(rows, line, "line")
    sf = _longest_run(rows, line & (F.col("sf_area") > F.col("_sf")), "sf")
    t = F.col("time_idx")
    second = F.try_element_at("line_times", F.lit(2))
    has_line = F.size("line_times") > 1
    late = has_line & (F.col("sf_first") > second + 2)
    mature = F.when(late, F.col("sf_first")).when(
        has_line & F.array_contains("sf_times", second + 2), second + 2
    )
    joined = (
        rows.join(cc, "track_id").join(ln, "track_id", "left").join(sf, "track_id", "left")
        .withColumns({"_second": F.when(has_line, second), "_mature": mature})
    )
    sf_last = F.when(has_line, F.col("sf_last"))
    # later rules overwrite earlier ones, so they are tested first
    stage = (
        F.when((sf_last < F.col("_len") - 1) & (t > sf_last), 5)
        .when(F.col("_mature").isNotNull() & t.between(F.col("_mature"), sf_last), 4)
        .when(F.col("_mature").isNotNull() & (t >= F.col("_second")) & (t < F.col("_mature")), 3)
        .when((F.col("_second") > F.col("cc_first")) & (t >= F.col("cc_first")) & (t < F.col("_second")), 2)
        .when((F.col("cc_first") > 0) & (F.col("cc_first") < F.col("_len") - 1) & (t < F.col("cc_first")), 1)
    )
    return (
        joined.withColumn("cycle_stage", stage)
        .withColumn("_stages", F.size(F.collect_set("cycle_stage").over(track)))
        .select(
            "track_id", "time_idx", "cycle_stage",
            F.when(F.col("_stages") >= 4, 1).alias("cycle_complete"),
        )
    )
