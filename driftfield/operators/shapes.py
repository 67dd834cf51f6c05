"""Shape and intensity statistics of labelled regions.

Everything is a sum over pixels (counts, first and second moments, third moment
of the intensity), so the aggregation is partial on the map side and a region of
any size is reduced to one row per task before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.operators.tiles import TILE, Wrap, tile_apply


def region_moments(pixels: DataFrame, keys: Sequence[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Raw moments per region; positions are taken relative to the region's own frame origin."""
    x, y, v = (F.col(c).cast("double") for c in ("x", "y", value))
    agg = {
        "npix": F.count(F.lit(1)),
        "_mx": F.avg(x), "_my": F.avg(y),
        "_vx": F.var_pop(x), "_vy": F.var_pop(y), "_cxy": F.covar_pop(x, y),
        "mean": F.avg(v), "peak": F.max(v), "total": F.sum(v),
        "skewness": F.skewness(v),
        "_wx": F.sum(v * x) / F.sum(v), "_wy": F.sum(v * y) / F.sum(v),
        **(extra or {}),
    }
    return pixels.groupBy(*keys).agg(*[c.alias(n) for n, c in agg.items()])


def shape_columns(pixel_km: Column | float) -> dict[str, Column]:
    """Ellipse with the region's second moments: axes, eccentricity, aspect, orientation."""
    km = pixel_km if isinstance(pixel_km, Column) else F.lit(float(pixel_km))
    vx, vy = F.col("_vx"), F.col("_vy")
    c = F.when(F.abs("_cxy") < 1e-12, 0.0).otherwise(F.col("_cxy"))
    mid = (vx + vy) / 2
    half = F.sqrt(((vx - vy) / 2) * ((vx - vy) / 2) + c * c)
    big = mid + half
    small = F.greatest(mid - half, F.lit(0.0))
    small = F.when(small < 1e-12, 0.0).otherwise(small)
    major, minor = F.sqrt(big) * 4.0 * km, F.sqrt(small) * 4.0 * km
    even = F.abs(vx - vy) < 1e-12
    tilt = F.when(even, F.when(c > 0, math.pi / 4).otherwise(-math.pi / 4)).otherwise(
        F.atan2(c * 2.0, vy - vx) * 0.5
    )
    return {
        "majoraxis": major,
        "minoraxis": minor,
        "aspectratio": F.when(minor > 0, major / minor),
        "eccentricity": F.when(big > 0, F.sqrt(1.0 - small / big)).otherwise(0.0),
        "orientation": F.degrees(tilt),
    }


def _border_weight(code: np.ndarray) -> np.ndarray:
    """Length of a border pixel from its pattern of border neighbours (2 per side, 10 per corner)."""
    # fixed values: neighbour patterns of the three step lengths
    straight = [5, 7, 15, 17, 25, 27]
    diagonal = [21, 33]
    mixed = [13, 23]
    table = np.zeros(64)
    table[straight] = 1.0
    table[diagonal] = math.sqrt(2)
    table[mixed] = (1 + math.sqrt(2)) / 2
    return table[code]


def perimeters(pixels: DataFrame, keys: Sequence[str], tile: int = TILE, wrap: Wrap | None = None) -> DataFrame:
    """Perimeter in pixels of each region (keys, region), from border patterns in halo tiles."""
    keys = list(keys)
    fields = {f.name: f for f in pixels.schema.fields}
    schema = T.StructType(
        [*[fields[k] for k in keys], fields["region"], fields["y"], fields["x"], T.StructField("_len", T.DoubleType())]
    )

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].to_numpy(np.int64)
        x = pdf["x"].to_numpy(np.int64)
        y0, x0 = y.min() - 1, x.min() - 1
        lab = np.full((y.max() - y0 + 2, x.max() - x0 + 2), -1, dtype=np.int64)
        _, own = np.unique(pdf["region"].to_numpy(), return_inverse=True)
        yy, xx = y - y0, x - x0
        lab[yy, xx] = own
        same = {
            (dy, dx): lab[yy + dy, xx + dx] == own
            for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)
        }
        inner = same[-1, 0] & same[1, 0] & same[0, -1] & same[0, 1]
        edge = np.zeros(lab.shape, dtype=bool)
        edge[yy, xx] = ~inner
        code = np.where(inner, 0, 1)
        for (dy, dx), hit in same.items():
            code = code + np.where(~inner & hit & edge[yy + dy, xx + dx], 2 if dy == 0 or dx == 0 else 10, 0)
        return pdf[[*keys, "region", "y", "x"]].assign(_len=_border_weight(code))

    px = pixels.select(*keys, "region", "y", "x")
    borders = tile_apply(px, kernel, schema, tile, halo=2, keys=tuple(keys), wrap=wrap)
    return borders.groupBy(*keys, "region").agg(F.sum("_len").alias("perimeter"))
