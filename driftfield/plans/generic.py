"""Generic objects: threshold, label, track, link small tracks, map back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.operators import label, mapback, systems
from driftfield.options import GenericOptions
from driftfield.plans.tracking import TrackTables, build_tracks
from driftfield.sources.filters import open_interval
from driftfield.workspace import Workspace


@dataclass
class GenericResult:
    labels: DataFrame
    features: DataFrame
    tracks: TrackTables
    main: DataFrame
    attached: DataFrame
    pixels: DataFrame


def identify(field: DataFrame, grid: DataFrame, ws: Workspace, opt: GenericOptions, value: str = "value"):
    """(labels with area and position, ranked features) of a field between two thresholds."""
    px = field.where(open_interval(value, *opt.field_range)).select("frame_id", "y", "x")
    regions = ws.write(
        label.label_regions(
            px, ws, tile=opt.tile, shape=opt.shape, periodic_y=opt.periodic_y, periodic_x=opt.periodic_x
        ),
        "regions",
    )
    sized = regions.join(grid.select("y", "x", "area_km2"), ["y", "x"]) if opt.min_area is not None else regions
    area = "area_km2" if opt.min_area is not None else None
    features = ws.write(label.rank_regions(sized, opt.min_npix, opt.min_area, area), "features")
    return ws.write(label.renumber(regions, features), "labels"), features


def run_generic(
    field: DataFrame,
    grid: DataFrame,
    frames: DataFrame,
    ws: Workspace,
    opt: GenericOptions,
    value: str = "value",
    find: Callable[[DataFrame, DataFrame, Workspace, GenericOptions, str], tuple[DataFrame, DataFrame]] = identify,
) -> GenericResult:
    """``field``: frame_id, y, x, value; ``grid``: y, x, lat, lon, area_km2; ``frames``: frame_id, epoch_s.

    ``find`` returns (frame_id, y, x, feature_id) pixels and (frame_id, feature_id, npix) features;
    any identification with that result can take the place of thresholds.
    """
    labels, features = find(field, grid, ws, opt, value)
    pixels = labels.join(grid.select("y", "x", "lat", "lon", "area_km2"), ["y", "x"])
    tracked = build_tracks(labels, features, frames, pixels, ws, opt, grid=grid)
    main = ws.write(systems.main_tracks(tracked.series, tracked.ends, opt.main_hours, opt.main_area, opt.dt_h), "main")
    attached = ws.write(
        systems.attachments(
            tracked.series, tracked.ends, main, opt.merge_hours, opt.split_hours, opt.dt_h, F.col("area")
        ),
        "attached",
    )
    main_series = tracked.series.join(main.select("track_id"), "track_id", "left_semi")
    mapped = mapback.map_tracks(labels, mapback.feature_assignment(main_series, attached))
    return GenericResult(labels, features, tracked, main, attached, mapped)
