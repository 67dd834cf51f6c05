"""Radar cells: classify echo, expand cores, advect, track with drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.functions import physics
from driftfield.operators import echo, image, link, mapback, motion, stats, vertical
from driftfield.options import CellOptions
from driftfield.plans.tracking import TrackTables, build_tracks
from driftfield.workspace import Workspace


@dataclass
class CellResult:
    echo: DataFrame
    cells: DataFrame
    tracks: TrackTables
    drift: DataFrame | None
    pixels: DataFrame


def domain_drift(found: DataFrame, frames: DataFrame, ws: Workspace, opt: CellOptions) -> DataFrame:
    """(frame_id, dy, dx): whole-pixel motion of the domain's echo until the next frame, smoothed in time."""
    moves = motion.tile_advection(
        found.select("frame_id", "y", "x", F.col("dbz_comp").alias("value")), link.frame_pairs(frames, opt.timegap_h), ws,
        opt.shape, (1, 1), 0, opt.advect_dbz, opt.dx_m / 1000, opt.dy_m / 1000, opt.dt_h * 3600, opt.advect_max_speed,
    )
    moves = motion.smooth_advection(ws.write(moves, "advection"), opt.dx_m / 1000, opt.dy_m / 1000, opt.dt_h * 3600, opt.advect_steps)
    return moves.select("frame_id", F.col("y").cast("int").alias("dy"), F.col("x").cast("int").alias("dx"))


def identify_cells(volume: DataFrame, ws: Workspace, opt: CellOptions) -> DataFrame:
    """Per pixel: dbz_comp, core, conv_mask, echo_class, core_id, cell and echo tops."""
    raised = volume.withColumn("dbz", physics.sensitivity_floor("dbz", opt.sensitivity_dbz))
    comp = vertical.composite(raised, "dbz")
    steps = physics.dilation_steps(**opt.steps)
    flagged = echo.classify_echo(
        comp, ws, "dbz_comp", opt.dx_m, opt.dy_m, opt.bkg_radius_m, opt.min_diff, opt.abs_thresh,
        opt.core_dbz, opt.weak_dbz, steps, opt.min_core_km2, shape=opt.shape, tile=opt.tile, wrap=opt.wrap,
    )
    numbered = echo.number_cores(ws.write(flagged, "echo"), ws, "conv_mask", 0, opt.shape, opt.tile, wrap=opt.wrap)
    cells = image.expand_cores(numbered, "core_id", opt.expand_km, opt.dx_m, opt.dy_m, tile=opt.tile, wrap=opt.wrap)
    tops = vertical.echo_tops(raised, "dbz", opt.echo_tops, opt.echotop_gap)
    return cells.join(tops, ["frame_id", "y", "x"], "left")


def run_cells(
    volume: DataFrame, grid: DataFrame, frames: DataFrame, ws: Workspace, opt: CellOptions, drift: DataFrame | None = None
) -> CellResult:
    """``volume``: frame_id, y, x, z, height_m, dbz; ``grid`` adds x_km, y_km and range_ok.

    With ``opt.advection`` and no given drift, cells are moved with the domain's echo before they are compared.
    """
    found = ws.write(identify_cells(volume, ws, opt), "cells")
    if drift is None and opt.advection:
        drift = ws.write(domain_drift(found, frames, ws, opt), "drift")
    labels = ws.write(
        found.where("cell > 0").select("frame_id", "y", "x", F.col("cell").alias("feature_id")), "labels"
    )
    features = ws.write(labels.groupBy("frame_id", "feature_id").agg(F.count(F.lit(1)).alias("npix")), "features")
    pixels = (
        found.where("cell > 0")
        .withColumn("feature_id", F.col("cell"))
        .withColumn("is_core", F.col("conv_mask"))
        .join(grid, ["y", "x"])
    )
    tracked = build_tracks(
        labels, features, frames, pixels, ws, opt, stats.radar_extras(tuple(opt.echo_tops)), drift, grid
    )
    mapped = ws.write(mapback.map_tracks(labels, mapback.feature_assignment(tracked.series)), "pixel_tracks")
    return CellResult(found, labels, tracked, drift, mapped)
