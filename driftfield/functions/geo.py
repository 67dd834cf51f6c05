"""Geometry on the sphere and movement vectors as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(h)) * (2 * EARTH_KM)


def cell_bounds(grid: DataFrame, value: str, along: str, keys: list[str]) -> DataFrame:
    """Add ``<value>_lo, <value>_hi``: midpoints to the neighbours, extrapolated at the ends."""
    w = Window.partitionBy(*keys).orderBy(along)
    here, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    low = (here + before) / 2
    high = (here + after) / 2
    return grid.withColumns(
        {
            f"{value}_lo": F.coalesce(low, here - (after - here) / 2),
            f"{value}_hi": F.coalesce(high, here + (here - before) / 2),
        }
    )


def with_cell_area(grid: DataFrame, radius_km: float = EARTH_KM) -> DataFrame:
    """Add ``area_km2`` = great-circle cell height x cell width at the cell centre."""
    bounded = cell_bounds(cell_bounds(grid, "lat", "y", ["x"]), "lon", "x", ["y"])
    height = haversine_km("lat_lo", "lon", "lat_hi", "lon")
    width = haversine_km("lat", "lon_lo", "lat", "lon_hi")
    return bounded.withColumn("area_km2", height * width * (radius_km / EARTH_KM) ** 2)


def with_mean_spacing_area(grid: DataFrame, radius_km: float = EARTH_KM) -> DataFrame:
    """Add ``area_km2`` = R^2 cos(lat) dlat dlon with mean grid spacings."""
    dlat = grid.agg((F.max("lat") - F.min("lat")) / (F.max("y") - F.min("y"))).scalar()
    dlon = grid.agg((F.max("lon") - F.min("lon")) / (F.max("x") - F.min("x"))).scalar()
    area = F.cos(F.radians("lat")) * F.radians(dlat) * F.radians(dlon) * radius_km**2
    return grid.withColumn("area_km2", area)


def mean_pixel_length(area: str = "area_km2") -> Column:
    return F.sqrt(F.avg(area))


def movement_vector(x, y, lag_s) -> dict[str, Column]:
    """Magnitude, heading (0 = north, clockwise, NULL at rest) and speed per second."""
    x, y = _col(x), _col(y)
    mag = F.sqrt(x * x + y * y)
    turn = -F.degrees(F.atan2(y, x)) + 90.0
    heading = F.when((x + y == 0) & (x * y == 0), F.lit(None)).when(turn < 0, turn + 360.0).otherwise(turn)
    return {"magnitude": mag, "heading": heading, "speed": mag / _col(lag_s)}


def advection_vector(x, y, lag_s, dx_km: float, dy_km: float) -> dict[str, Column]:
    """Domain motion: distance [km], bearing (-180..180 from north) and speed [m/s]."""
    east, north = _col(x) * dx_km, _col(y) * dy_km
    mag = F.sqrt(east * east + north * north)
    return {
        "magnitude": mag,
        "bearing": F.degrees(F.atan2(east, north)),
        "speed": mag / _col(lag_s) * 1000.0,
    }


def to_0_360(lon) -> Column:
    lon = _col(lon)
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def semi_symmetric(index, size: int) -> Column:
    """Whole-number coordinate around zero; an even grid has one more cell on the positive side."""
    return _col(index) - (math.ceil(size / 2) - 1)


def range_mask(x, y, radius) -> Column:
    x, y = _col(x), _col(y)
    return (F.sqrt(x * x + y * y) <= radius).cast("int")
