"""Cold-cloud and rain systems: grow clouds, track, select, match rain, map back, move."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.operators import clouds, label, link, mapback, motion, precip, smooth, stats, systems
from driftfield.options import ConvectiveOptions
from driftfield.plans.tracking import TrackTables, build_tracks
from driftfield.workspace import Workspace


@dataclass
class ConvectiveResult:
    clouds: DataFrame
    tracks: TrackTables
    systems: DataFrame
    series: DataFrame
    attached: DataFrame
    rain_totals: DataFrame
    rain_features: DataFrame
    robust: DataFrame
    pixels: DataFrame
    movement: DataFrame


def link_by_rain(grown: DataFrame, ws: Workspace, opt: ConvectiveOptions) -> DataFrame:
    """Clouds under one rain feature become one cloud; clouds are numbered by size again."""
    at = ["frame_id", "y", "x"]
    wet = grown.where(F.col("rain") > opt.link_rain_min).select(*at)
    regions = ws.write(label.label_regions(wet, ws, tile=opt.tile, shape=opt.shape, wrap=opt.wrap), "linking_rain")
    numbers = label.renumber(regions, label.rank_regions(regions, opt.link_rain_npix))
    rain = numbers.select(*at, F.col("feature_id").alias("pf_number"))
    known = grown.join(rain, at, "left").withColumn("pf_number", F.coalesce("pf_number", F.lit(0)))
    linked = clouds.link_rain_clouds(ws.write(known, "rain_numbered"), ws)
    linked = ws.write(linked.select(*at, "pf_convcold_cloudnumber", "pf_cloudnumber"), "linked_clouds")
    final, _ = label.renumber_pair(linked, "pf_convcold_cloudnumber", "pf_cloudnumber", min_npix=1)
    final = final.select(
        *at, F.col("pf_convcold_cloudnumber").alias("convcold_cloudnumber"), F.col("pf_cloudnumber").alias("cloudnumber")
    )
    return ws.write(grown.drop("convcold_cloudnumber", "cloudnumber").join(final, at), "rain_linked")


def run_convective(
    field: DataFrame, grid: DataFrame, frames: DataFrame, ws: Workspace, opt: ConvectiveOptions
) -> ConvectiveResult:
    """``field``: frame_id, y, x, tb, rain; ``grid``: y, x, lat, lon, area_km2, landfrac."""
    with_area = field.join(grid.select("y", "x", "area_km2"), ["y", "x"])
    bands = (opt.tb_core, opt.tb_cold, opt.tb_warm, opt.tb_cloud)
    grown = ws.write(
        clouds.grow_cold_clouds(
            with_area, ws, bands, opt.cloud_area, opt.min_core_npix, opt.smooth_size, opt.shape,
            opt.warm_expansion, tile=opt.tile, carry=("rain",), wrap=opt.wrap,
        ),
        "grown",
    )
    if opt.link_rain:
        grown = link_by_rain(grown, ws, opt)
    # tb and rain ride along with the clouds, so nothing joins back to the full field
    pixels = ws.write(
        grown.where("convcold_cloudnumber > 0")
        .withColumn("feature_id", F.col("convcold_cloudnumber"))
        .select("frame_id", "y", "x", "feature_id", "tb", "rain", "cloudtype", "area_km2")
        .join(grid.select("y", "x", "lat", "lon", "landfrac"), ["y", "x"]),
        "cloud_pixels",
    )
    labels = pixels.select("frame_id", "y", "x", "feature_id", "rain")
    features = ws.write(labels.groupBy("frame_id", "feature_id").agg(F.count(F.lit(1)).alias("npix")), "features")
    tracked = build_tracks(labels, features, frames, pixels, ws, opt, stats.tb_extras(), grid=grid)
    chosen = ws.write(
        systems.cold_systems(tracked.series, opt.system_area, opt.system_hours, opt.system_gap, opt.dt_h), "systems"
    )
    series = ws.write(
        smooth.smooth_tracks(systems.system_series(tracked.series, chosen, opt.system_area), step_h=opt.dt_h),
        "system_series",
    )
    shield = F.col("core_area") + F.col("cold_area")
    attached = ws.write(
        systems.attachments(tracked.series, tracked.ends, chosen, opt.merge_hours, opt.split_hours, opt.dt_h, shield),
        "attached",
    )
    sys_px = ws.write(precip.system_pixels(pixels, precip.system_features(series, attached)), "system_pixels")
    totals = ws.write(precip.rain_totals(sys_px, opt.rain_min, opt.rain_heavy, opt.land), "rain_totals")
    feats, _ = precip.rain_features(
        sys_px, ws, opt.rain_min, opt.rain_heavy, opt.rain_area, opt.pixel_km, opt.keep_features, opt.shape, opt.tile,
        opt.wrap, stats.coordinate_ranges(grid, opt.periodic_y, opt.periodic_x),
    )
    feats = ws.write(precip.place_centroids(feats, grid), "rain_features")
    largest = feats.where("pf_rank = 1").select(
        "track_id", "time_idx", "pf_majoraxis", "pf_area", "pf_rainrate", "pf_skewness", "pf_maxrainrate"
    )
    robust = ws.write(
        systems.robust_by_rain(
            totals.join(largest, ["track_id", "time_idx"], "left"),
            (opt.axis_min, opt.axis_max), opt.rain_hours, opt.rain_gap, opt.dt_h,
            opt.coef_area, opt.coef_rate, opt.coef_skew, opt.coef_heavy,
        ),
        "robust",
    )
    keep = robust.select("track_id").distinct()
    final = series.join(keep, "track_id", "left_semi")
    parts = attached.join(keep, "track_id", "left_semi")
    mapped = ws.write(
        mapback.map_tracks(labels, mapback.feature_assignment(final, parts), rain_min=opt.pcp_thresh),
        "pixel_tracks",
    )
    moving = mapped.where("pcptracknumber > 0").select(
        F.col("pcptracknumber").alias("track_id"), "frame_id", "y", "x", F.col("rain").alias("value")
    )
    moves = motion.feature_motion(moving, link.frame_pairs(frames, opt.timegap_h), ws, opt.motion_npix, opt.pixel_km, wrap=opt.wrap)
    aligned = final.select("track_id", "frame_id", "time_idx").join(moves, ["track_id", "frame_id"], "left")
    return ConvectiveResult(
        grown, tracked, chosen, series, attached, totals, feats, robust, mapped,
        motion.filter_speed(aligned, opt.max_speed),
    )
