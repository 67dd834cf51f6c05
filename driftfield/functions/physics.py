"""Scalar conversions and classifications as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

CORE, COLD, WARM, OTHER, CLEAR = 1, 2, 3, 4, 5

# fixed values: outgoing longwave radiation to brightness temperature
OLR_A, OLR_B, STEFAN = 1.228, -1.106e-3, 5.67e-8
GRAVITY = 9.81


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def olr_to_tb(olr: Column | str) -> Column:
    """Brightness temperature [K] of outgoing longwave radiation [W m-2]; NULL where no temperature emits it."""
    flux = F.pow(_col(olr) / STEFAN, 0.25)
    inner = OLR_A * OLR_A + 4.0 * OLR_B * flux
    return F.when((_col(olr) >= 0) & (inner >= 0), (F.sqrt(inner) - OLR_A) / (2.0 * OLR_B))


def scaled_rain(rate: Column | str, factor: float = 1.0) -> Column:
    """Rain rate in new units; negative rates count as none."""
    return F.greatest(_col(rate) * factor, F.lit(0.0))


def within(value: Column | str, low: float, high: float) -> Column:
    """NULL outside [low, high]."""
    value = _col(value)
    return F.when(value.between(low, high), value)


def cloud_type(tb: Column | str, core: float, cold: float, warm: float, cloud: float) -> Column:
    """Half-open temperature bands: 1 core, 2 cold, 3 warm, 4 other cloud, 5 clear; NULL if missing."""
    tb = _col(tb)
    return (
        F.when(tb < core, CORE)
        .when(tb < cold, COLD)
        .when(tb < warm, WARM)
        .when(tb < cloud, OTHER)
        .when(tb >= cloud, CLEAR)
    )


def dbz_to_linear(dbz: Column | str) -> Column:
    return F.pow(F.lit(10.0), _col(dbz) / 10.0)


def linear_to_dbz(z: Column | str) -> Column:
    return F.log10(_col(z)) * 10.0


def peakedness_limit(background: Column | str, min_diff: float, abs_thresh: float) -> Column:
    """Required excess over the background for a convective centre (cosine fall-off)."""
    b = _col(background)
    return (
        F.when(b < 0, min_diff)
        .when(b < abs_thresh, F.cos(b * math.pi / (2 * abs_thresh)) * min_diff)
        .when(b >= abs_thresh, 0.0)
    )


def dilation_steps(
    min_bkg: float = 25,
    max_bkg: float = 40,
    bkg_step: float = 5,
    radius_step: float = 1,
    radius_start: float = 1,
    max_radius: float = 5,
) -> tuple[list[float], list[float]]:
    """Background bin edges [dBZ] and the convective radius [km] of each bin."""
    n = math.ceil((max_bkg + 0.1 - min_bkg) / bkg_step)
    edges = [0.0] + [min_bkg + i * bkg_step for i in range(n)] + [100.0]
    radii = [min(i * radius_step + radius_start, max_radius) for i in range(n + 1)]
    return edges, radii


def convective_radius(background: Column | str, edges: Sequence[float], radii: Sequence[float]) -> Column:
    """Radius of the background's bin: first bin up to its edge, last from its edge on."""
    b = _col(background)
    last = len(radii) - 1
    out = F.when(b >= edges[last], float(radii[last]))
    for i in range(last - 1, 0, -1):
        out = out.when((b < edges[i + 1]) & (b >= edges[i]), float(radii[i]))
    return out.when(b <= edges[1], float(radii[0]))


def vertical_scale(
    units: str | None,
    kind: str = "height",
    scale: float | None = None,
    override: str | None = None,
) -> float:
    """Factor that brings a vertical coordinate to metres (height) or hPa (pressure).

    A given ``scale`` wins, then the ``override`` unit, then the declared unit; a
    coordinate without any unit is taken as it is.  Geopotential heights and
    unknown units are refused.
    """
    if scale is not None:
        return scale
    declared = override if override is not None else units
    if declared is None:
        return 1.0
    name = declared.strip().lower()
    if kind == "height":
        if "gpm" in name or "geopotential" in name:
            raise ValueError(f"geopotential height '{declared}' needs an explicit scale")
        if "km" in name or "kilomet" in name:
            return 1000.0
        if name in {"m", "meter", "meters", "metre", "metres"}:
            return 1.0
    elif kind == "pressure":
        if name in {"pa", "pascal", "pascals"}:
            return 0.01
        if name in {"hpa", "mb", "mbar", "millibar", "millibars", "hectopascal", "hectopascals"}:
            return 1.0
    else:
        raise ValueError(f"unknown vertical coordinate kind '{kind}'")
    raise ValueError(f"cannot convert {kind} unit '{declared}'")


def sensitivity_floor(dbz: Column | str, floor: float) -> Column:
    return F.greatest(F.coalesce(nan_to_null(dbz), F.lit(floor)), F.lit(floor))


def quality_mask(value: Column | str, quality: Column | str, limit: float = 0.5) -> Column:
    return F.when(_col(quality) >= limit, _col(value))


def low_level(height: Column | str, low: float, high: float, is_pressure: bool = False) -> Column:
    """Predicate for the low-level window; a pressure axis counts downward."""
    height = _col(height)
    return height.between(high, low) if is_pressure else height.between(low, high)


def buoyancy(theta: str, keys: Sequence[str] = ("frame_id", "z")) -> Column:
    """Acceleration relative to the mean of each level, from window averages."""
    mean = F.avg(theta).over(Window.partitionBy(*keys))
    return (F.col(theta) - mean) * GRAVITY / mean
