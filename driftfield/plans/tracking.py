"""Shared middle part of every plan: link, number, summarise tracks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from driftfield.operators import link, stats, tracks
from driftfield.options import TrackingOptions
from driftfield.workspace import Workspace


@dataclass
class TrackTables:
    links: DataFrame
    points: DataFrame
    series: DataFrame
    ends: DataFrame


def build_tracks(
    labels: DataFrame,
    features: DataFrame,
    frames: DataFrame,
    pixels: DataFrame,
    ws: Workspace,
    opt: TrackingOptions,
    extra: dict[str, Column] | None = None,
    drift: DataFrame | None = None,
    grid: DataFrame | None = None,
) -> TrackTables:
    """``labels``: frame_id, y, x, feature_id; ``pixels``: the same with lat, lon, area_km2 and fields.

    On a periodic domain mean positions are circular over the range of ``grid``'s pixel
    centres, and tracks that cross the edge go on beyond it (``pbc_flag`` marks them).
    """
    ranges = stats.coordinate_ranges(grid if grid is not None else pixels, opt.periodic_y, opt.periodic_x)
    pairs = link.frame_pairs(frames, opt.timegap_h)
    links = ws.write(link.overlap_links(labels, pairs, opt.othresh, drift, opt.shape, features), "links")
    points = ws.write(tracks.number_tracks(features, links, pairs, ws, opt.othresh), "track_points")
    per_feature = stats.feature_stats(pixels, extra, **ranges)
    series = stats.track_series(points, per_feature, frames)
    jumps = {
        f"mean{axis}": (span[1] - span[0]) * opt.wrap_fraction
        for axis, span in (("lat", ranges["lat_range"]), ("lon", ranges["lon_range"]))
        if span
    }
    if jumps:
        series = stats.unwrap_positions(series, jumps, opt.wrap_fraction)
    series = ws.write(series, "all_series")
    if opt.drop_short:
        series = ws.write(
            stats.drop_short_tracks(series, stats.track_ends(series), min(opt.duration_range)), "series"
        )
    return TrackTables(links, points, series, ws.write(stats.track_ends(series), "ends"))
