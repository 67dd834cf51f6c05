"""Coarsening, refining, weight-based and nearest-cell remapping, HEALPix cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coarsen(df: DataFrame, keys: Sequence[str], value: str, ratio: int, linear_z: bool = False) -> DataFrame:
    """Box means of ratio x ratio pixels (reflectivity averaged in linear units)."""
    v = F.pow(F.lit(10.0), F.col(value) / 10) if linear_z else F.col(value)
    mean = F.avg(v)
    mean = F.log10(mean) * 10 if linear_z else mean
    return df.groupBy(
        *keys,
        F.floor(F.col("y") / ratio).cast("int").alias("y"),
        F.floor(F.col("x") / ratio).cast("int").alias("x"),
    ).agg(mean.alias(value))


def refine(df: DataFrame, ratio: int) -> DataFrame:
    """Each coarse pixel repeated on its ratio x ratio fine pixels (odd ratios only)."""
    if ratio % 2 == 0:
        raise ValueError("the refinement ratio must be odd")
    steps = F.sequence(F.lit(0), F.lit(ratio - 1))
    return (
        df.withColumn("_i", F.explode(steps))
        .withColumn("_j", F.explode(steps))
        .withColumns(
            {"y": (F.col("y") * ratio + F.col("_i")).cast("int"), "x": (F.col("x") * ratio + F.col("_j")).cast("int")}
        )
        .drop("_i", "_j")
    )


def apply_weights(df: DataFrame, weights: DataFrame, value: str, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Sparse remapping: ``weights`` (y, x, dst_y, dst_x, w) times the source pixels."""
    return (
        df.join(weights, ["y", "x"])
        .groupBy(*keys, F.col("dst_y").alias("y"), F.col("dst_x").alias("x"))
        .agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))
    )


def cell_tolerance(zoom: int) -> float:
    """About one cell width in degrees."""
    return 58.6 / 2**zoom


def nested_cell(lat: Column, lon: Column, zoom: int) -> Column:
    """Nested HEALPix index of a position (equal-area cells, 12 base faces).

    Positions map to a diamond coordinate on a base face; the index interleaves
    the bits of the two diamond coordinates below the face number.
    """
    nside = 1 << zoom
    z = F.sin(F.radians(lat))
    tt = F.pmod(lon / 90.0, F.lit(4.0))
    belt = F.abs(z) <= 2.0 / 3.0

    # equatorial belt: two families of diagonal lines
    t1, t2 = (tt + 0.5) * nside, z * (nside * 0.75)
    jp, jm = F.floor(t1 - t2), F.floor(t1 + t2)
    fp, fm = F.floor(jp / nside), F.floor(jm / nside)
    face_b = F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, F.pmod(fp, F.lit(4))).otherwise(F.pmod(fm, F.lit(4)) + 8)
    ix_b, iy_b = F.pmod(jm, F.lit(nside)), F.lit(nside - 1) - F.pmod(jp, F.lit(nside))

    # polar caps
    q = F.least(F.floor(tt), F.lit(3))
    tp = tt - q
    s = F.sqrt((F.lit(1.0) - F.abs(z)) * 3.0) * nside
    a = F.least(F.floor(tp * s), F.lit(nside - 1))
    b = F.least(F.floor((F.lit(1.0) - tp) * s), F.lit(nside - 1))
    north = z >= 0
    face_p = F.when(north, q).otherwise(q + 8)
    ix_p = F.when(north, F.lit(nside - 1) - b).otherwise(a)
    iy_p = F.when(north, F.lit(nside - 1) - a).otherwise(b)

    face = F.when(belt, face_b).otherwise(face_p).cast("long")
    ix, iy = F.when(belt, ix_b).otherwise(ix_p).cast("long"), F.when(belt, iy_b).otherwise(iy_p).cast("long")
    index = face * (nside * nside)
    for bit in range(zoom):
        index = index + F.shiftleft(F.shiftright(ix, bit).bitwiseAND(1), 2 * bit)
        index = index + F.shiftleft(F.shiftright(iy, bit).bitwiseAND(1), 2 * bit + 1)
    return index


def _on_rings(cells: DataFrame, zoom: int) -> DataFrame:
    """``cells`` with their ring (from the north), place on it (from 0), cells in a quarter of it and half-cell shift.

    Each step is a projection of its own, so no expression is evaluated twice.
    """
    nside = 1 << zoom
    c = F.col
    ix = iy = F.lit(0).cast("long")
    for bit in range(zoom):
        ix = ix + F.shiftleft(F.shiftright(c("cell"), 2 * bit).bitwiseAND(1), bit)
        iy = iy + F.shiftleft(F.shiftright(c("cell"), 2 * bit + 1).bitwiseAND(1), bit)
    row = F.floor(c("_face") / 4)  # northern, equatorial and southern base faces
    cap = (c("_ring") < nside) | (c("_ring") > 3 * nside)
    return (
        cells.withColumns({"_face": F.shiftright(c("cell").cast("long"), 2 * zoom), "_ix": ix, "_iy": iy})
        .withColumns(
            {
                "_corner": F.pmod(c("_face"), F.lit(4)) * 2 + F.when(row == 1, 0).otherwise(1),
                "_ring": (row + 2) * nside - c("_ix") - c("_iy") - 1,
            }
        )
        .withColumns(
            {
                "_quarter": F.when(~cap, F.lit(nside)).otherwise(F.least(c("_ring"), 4 * nside - c("_ring"))),
                "_shift": F.when(cap, 0).otherwise(F.pmod(c("_ring") - nside, F.lit(2))),
            }
        )
        .withColumn("_place", F.floor((c("_corner") * c("_quarter") + c("_ix") - c("_iy") + 1 + c("_shift")) / 2) - 1)
        .withColumn("_place", F.pmod("_place", c("_quarter") * 4))
        .drop("_face", "_ix", "_iy", "_corner")
    )


def cell_centres(cells: DataFrame, zoom: int) -> DataFrame:
    """``cells`` (cell, ...) with lat_hp, lon_hp (0 to 360) of the centres of nested HEALPix cells, and their ring numbers.

    ``ring_cell`` counts cells along the rings from the north pole.
    """
    nside, c = 1 << zoom, F.col
    ring, quarter, place = c("_ring"), c("_quarter"), c("_place")
    drop = quarter * quarter / (3.0 * nside * nside)
    z = F.when(ring < nside, 1.0 - drop).when(ring > 3 * nside, drop - 1.0).otherwise((2 * nside - ring) * 2.0 / (3.0 * nside))
    north = 2 * quarter * (quarter - 1) + place
    south = 12 * nside * nside - 2 * quarter * (quarter + 1) + place
    belt = 2 * nside * (nside - 1) + (ring - nside) * 4 * nside + place
    return (
        _on_rings(cells, zoom)
        .withColumns(
            {
                "lat_hp": F.degrees(F.asin(z)),
                "lon_hp": (place + 0.5 - c("_shift") * 0.5) * 90.0 / quarter,
                "ring_cell": F.when(ring < nside, north).when(ring > 3 * nside, south).otherwise(belt).cast("long"),
            }
        )
        .drop("_ring", "_quarter", "_shift", "_place")
    )


def cells_to_grid(cells: DataFrame, grid: DataFrame, zoom: int) -> DataFrame:
    """Values of ``cells`` (cell, ...) gathered on grid positions (y, x, lat, lon)."""
    return grid.withColumn("cell", nested_cell(F.col("lat"), F.col("lon"), zoom)).join(cells, "cell")


def grid_to_cells(
    pixels: DataFrame, cells: DataFrame, lat0: float, lon0: float, step: float, tolerance: float
) -> DataFrame:
    """Nearest pixel of a regular grid for each cell centre, within the tolerance.

    Rounding gives the nearest grid address, so this is an equi-join on (y, x).
    ``cells``: cell, lat_hp, lon_hp; ``pixels``: y, x, lat, lon, values.
    """
    at = cells.withColumns(
        {
            "y": F.round((F.col("lat_hp") - lat0) / step).cast("int"),
            "x": F.round((F.col("lon_hp") - lon0) / step).cast("int"),
        }
    )
    near = (F.abs(F.col("lat") - F.col("lat_hp")) < tolerance) & (F.abs(F.col("lon") - F.col("lon_hp")) < tolerance)
    return at.join(pixels, ["y", "x"]).where(near)


def hourly_mean(rows: DataFrame, value: str, time: str = "ts") -> DataFrame:
    """Sub-hourly fields averaged to the hour they start in."""
    return rows.groupBy(F.date_trunc("hour", time).alias(time), "y", "x").agg(F.avg(value).alias(value))


def combine_fields(left: DataFrame, right: DataFrame, time: str = "ts") -> DataFrame:
    """Two fields on the same grid and hours, side by side."""
    return left.join(right, [time, "y", "x"])
