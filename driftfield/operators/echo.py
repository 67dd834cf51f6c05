"""Convective / stratiform classification of radar echo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.functions import physics
from driftfield.operators import image, label
from driftfield.operators.tiles import Wrap
from driftfield.workspace import Workspace

NO_SURF_ECHO, WEAK_ECHO, STRATIFORM, CONVECTIVE = 1, 2, 3, 4


def classic_steps(min_bkg: float, max_radius: int, max_bkg: float) -> tuple[list[float], list[float]]:
    """Step function of the original scheme: radii 0, 1, ... over the background bins."""
    edges = [0.0, float(min_bkg)]
    edge = max_bkg - 15.0
    while edge < max_bkg + 5.0:
        edges.append(edge)
        edge += 5.0
    return edges + [100.0], [float(r) for r in range(max_radius + 1)]


def classify_echo(
    df: DataFrame,
    ws: Workspace,
    dbz: str,
    dx_m: float,
    dy_m: float,
    bkg_radius_m: float,
    min_diff: float,
    abs_thresh: float,
    core_dbz: float,
    weak_dbz: float,
    steps: tuple[list[float], list[float]],
    min_core_km2: float | None = None,
    min_cell_km2: float | None = None,
    shape: tuple[int, int] | None = None,
    tile: int = image.TILE,
    wrap: Wrap | None = None,
) -> DataFrame:
    """Adds background, peakedness, core, conv_mask (dilated core) and echo_class.

    With area limits, cores and dilated cells smaller than the limit are removed;
    a cell removed this way keeps its class.
    """
    pixel_km2 = dx_m * dy_m / 1e6
    v, bkg = F.col(dbz), F.col("background")
    df = image.background_mean(df, dbz, bkg_radius_m, dx_m, dy_m, tile=tile, wrap=wrap)
    df = df.withColumn("peakedness", physics.peakedness_limit("background", min_diff, abs_thresh))
    is_core = (v >= core_dbz) | (v - bkg >= F.col("peakedness"))
    base = (
        F.when(v < min_diff, NO_SURF_ECHO)
        .when((v > min_diff) & (v < weak_dbz), WEAK_ECHO)
        .when(is_core, CONVECTIVE)
        .when(v.isNotNull(), STRATIFORM)
        .otherwise(0)
    )
    edges, radii = steps
    df = df.withColumns(
        {
            "core": F.coalesce(is_core.cast("int"), F.lit(0)),
            "echo_class": base,
            "conv_radius": F.coalesce(physics.convective_radius("background", edges, radii), F.lit(0.0)),
        }
    )
    if min_core_km2 is not None:
        df = _drop_small(df, ws, "core", int(min_core_km2 / pixel_km2), shape, tile, wrap)
    df = image.dilate_cores(df, "core", "conv_radius", max(radii), dx_m, dy_m, "conv_mask", tile, wrap)
    df = df.withColumns(
        {
            "conv_mask": F.when(v.isNotNull(), F.col("conv_mask")).otherwise(F.col("core")),
            "echo_class": F.when(v.isNotNull() & (F.col("conv_mask") == 1) & (F.col("conv_radius") >= 0), CONVECTIVE)
            .otherwise(F.col("echo_class")),
        }
    )
    if min_cell_km2 is not None:
        df = _drop_small(df, ws, "conv_mask", int(min_cell_km2 / pixel_km2), shape, tile, wrap)
    return df.drop("conv_radius")


def _drop_small(df: DataFrame, ws: Workspace, flag: str, min_npix: int, shape, tile: int, wrap: Wrap | None) -> DataFrame:
    """Clear the flag of regions with fewer than ``min_npix`` pixels."""
    df = ws.write(df, "echo")
    px = df.where(F.col(flag) == 1).select("frame_id", "y", "x")
    regions = ws.write(label.label_regions(px, ws, shape=shape, tile=tile, wrap=wrap), "echo_regions")
    small = regions.groupBy("frame_id", "region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_npix)
    gone = regions.join(small, ["frame_id", "region"], "left_semi").select(
        "frame_id", "y", "x", F.lit(True).alias("_gone")
    )
    return (
        df.join(gone, ["frame_id", "y", "x"], "left")
        .withColumn(flag, F.when(F.col("_gone"), 0).otherwise(F.col(flag)))
        .drop("_gone")
    )


def number_cores(
    df: DataFrame, ws: Workspace, flag: str, min_npix: float, shape=None, tile: int = image.TILE, out: str = "core_id",
    wrap: Wrap | None = None,
) -> DataFrame:
    """Size-ranked numbers of the flagged regions above ``min_npix`` pixels (strict), 0 elsewhere."""
    px = df.where(F.col(flag) == 1).select("frame_id", "y", "x")
    regions = ws.write(label.label_regions(px, ws, shape=shape, tile=tile, wrap=wrap), "core_regions")
    numbered = label.renumber(regions, label.rank_regions(regions, min_npix)).withColumnRenamed("feature_id", out)
    return df.join(numbered, ["frame_id", "y", "x"], "left").withColumn(out, F.coalesce(out, F.lit(0)))
