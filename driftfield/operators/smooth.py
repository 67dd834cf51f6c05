"""Trajectory repair: outliers by speed, then linear interpolation along the track.

Rows are grouped by track; a track has at most one row per frame.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.functions.geo import EARTH_KM


def _distance_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a1, a2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(h))


def reachable(lon: np.ndarray, lat: np.ndarray, max_kmh: float, step_h: float) -> np.ndarray:
    """Mask of points reachable from the last accepted point within the speed limit."""
    ok = np.isfinite(lon) & np.isfinite(lat)
    last = None
    for i in np.nonzero(ok)[0]:
        if last is not None:
            km = _distance_km(lat[last], lon[last], lat[i], lon[i])
            if km / ((i - last) * step_h) > max_kmh:
                ok[i] = False
                continue
        last = i
    return ok


def repair(lon: np.ndarray, lat: np.ndarray, max_kmh: float, step_h: float) -> tuple[np.ndarray, np.ndarray]:
    """Best of three scans (from the first, second or third point), gaps interpolated.

    A scan that keeps its first point wins over one that does not, then the one
    that drops fewest points; the first two positions are restored at the end.
    """
    n = len(lon)
    best = None
    for start in range(3):
        skip = start if n > start else 0
        ok = np.zeros(n, dtype=bool)
        ok[skip:] = reachable(lon[skip:], lat[skip:], max_kmh, step_h)
        dropped = int((~ok[skip:]).sum())
        head_lost = not ok[skip] if skip == start else False
        # scans that keep their first point sort after those that lost it
        rank = (not head_lost, dropped)
        if best is None or rank < best[0]:
            best = (rank, ok)
    ok = best[1]
    out_lon, out_lat = np.where(ok, lon, np.nan), np.where(ok, lat, np.nan)
    at = np.nonzero(ok)[0]
    if len(at):
        inside = np.arange(at[0], at[-1] + 1)
        out_lon[inside] = np.interp(inside, at, lon[at])
        out_lat[inside] = np.interp(inside, at, lat[at])
    for i in range(min(2, n)):
        if np.isnan(out_lon[i]) and not np.isnan(lon[i]):
            out_lon[i], out_lat[i] = lon[i], lat[i]
    return out_lon, out_lat


def fill_changed(values: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Interpolate values at moved points from the untouched ones around them."""
    keep = np.nonzero(~moved & np.isfinite(values))[0]
    out = values.copy()
    if len(keep) > 1:
        at = np.nonzero(moved)[0]
        at = at[(at >= keep[0]) & (at <= keep[-1])]
        out[at] = np.interp(at, keep, values[keep])
    return out


def smooth_tracks(
    series: DataFrame, max_kmh: float = 100.0, step_h: float = 1.0, lon: str = "meanlon", lat: str = "meanlat",
    values: tuple[str, ...] = (),
) -> DataFrame:
    """Adds <lon>_smooth and <lat>_smooth, and <value>_smooth for each of ``values``."""
    out_cols = [f"{lon}_smooth", f"{lat}_smooth", *[f"{v}_smooth" for v in values]]
    schema = T.StructType([*series.schema.fields, *[T.StructField(c, T.DoubleType()) for c in out_cols]])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time_idx").reset_index(drop=True)
        x, y = pdf[lon].to_numpy(float), pdf[lat].to_numpy(float)
        sx, sy = repair(x, y, max_kmh, step_h)
        pdf[f"{lon}_smooth"], pdf[f"{lat}_smooth"] = sx, sy
        moved = ~((sx == x) & (sy == y))
        for v in values:
            pdf[f"{v}_smooth"] = fill_changed(pdf[v].to_numpy(float), moved)
        return pdf

    out = series.groupBy("track_id").applyInPandas(kernel, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in out_cols})
