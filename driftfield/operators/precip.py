"""Rain inside tracked systems: totals per time and rain features by size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.operators import label, shapes, stats
from driftfield.operators.ranking import exact_quantile
from driftfield.operators.tiles import Wrap
from driftfield.workspace import Workspace

KEYS = ["track_id", "frame_id"]


def system_features(series: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    """(track_id, frame_id, feature_id): a system's own feature and its attached ones."""
    own = series.select("track_id", "frame_id", "time_idx", F.col("cloudnumber").alias("feature_id"))
    if attached is None:
        return own
    clock = series.select("track_id", "time_idx", "frame_id")
    parts = attached.join(clock, ["track_id", "time_idx"]).select(
        "track_id", "frame_id", "time_idx", F.col("cloudnumber").alias("feature_id")
    )
    return own.unionByName(parts).distinct()


def system_pixels(labelled: DataFrame, members: DataFrame) -> DataFrame:
    """Pixels of each system and time (a pixel may serve several systems)."""
    return labelled.join(members, ["frame_id", "feature_id"]).drop("feature_id")


def rain_totals(
    pixels: DataFrame, rain_min: float, heavy: float, land: tuple[float, float] | None = None
) -> DataFrame:
    """Totals per (track, frame); ``rainrate_p95`` is exact with linear interpolation."""
    r, area = F.col("rain"), F.col("area_km2")
    wet, hard = r > rain_min, r > heavy
    agg = {
        "total_rain": F.coalesce(F.sum(r), F.lit(0.0)),
        "total_volrain": F.coalesce(F.sum(r * area), F.lit(0.0)),
        "total_heavyrain": F.sum(F.when(hard, r)),
        "total_heavyvolrain": F.sum(F.when(hard, r * area)),
        "rainrate_heavyrain": F.avg(F.when(hard, r)),
    }
    if land is not None:
        on_land = wet & F.col("landfrac").between(*land)
        agg["pf_landfrac"] = F.sum(on_land.cast("int")) / F.nullif(F.sum(wet.cast("int")), F.lit(0))
    totals = pixels.groupBy(*KEYS, "time_idx").agg(*[c.alias(n) for n, c in agg.items()])
    p95 = exact_quantile(pixels.where(wet), KEYS, "rain", 0.95, "rainrate_p95")
    return totals.join(p95, KEYS, "left")


def rain_features(
    pixels: DataFrame,
    ws: Workspace,
    rain_min: float,
    heavy: float,
    min_area: float,
    pixel_km: float,
    keep: int | None = None,
    shape: tuple[int, int] | None = None,
    tile: int = label.TILE,
    wrap: Wrap | None = None,
    ranges: dict[str, tuple[float, float] | None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Contiguous rain features per (track, frame).

    Returns (features, counts): all features of a system and time above the size
    limit, by size as pf_rank 1.. (the ``keep`` largest, if asked for), and pf_npf,
    their number.  Where edges of the grid meet (``wrap``), features go on beyond them: their shape
    is that of the feature in one piece, mean positions are circular over ``ranges``.
    """
    ranges = ranges or {}
    wet = pixels.where(F.col("rain") > rain_min).select(*KEYS, "y", "x")
    regions = ws.write(label.label_regions(wet, ws, keys=KEYS, shape=shape, tile=tile, wrap=wrap), "rain_regions")
    ranked = label.rank_regions(regions, math.ceil(min_area / pixel_km**2), keys=KEYS)
    ranked = ws.write(ranked.select(*KEYS, "region", F.col("feature_id").alias("pf_rank")), "rain_ranks")
    counts = ranked.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("pf_npf"))
    chosen = ranked.where(F.col("pf_rank") <= keep) if keep else ranked
    px = regions.join(chosen, [*KEYS, "region"]).join(pixels, [*KEYS, "y", "x"])
    length = shapes.perimeters(px, KEYS, tile, wrap)
    shifts = {}
    if wrap is not None:
        px = stats.unrolled(px, [*KEYS, "region"], wrap)
        shifts = {f"_shift_{a}": F.first(f"_shift_{a}") for a in ("y", "x")}

    def position(name: str):
        span = ranges.get(f"{name}_range")
        return stats.circular_mean(F.col(name), *span) if span else F.avg(name)

    hard = F.col("rain") > heavy
    moments = shapes.region_moments(
        px,
        [*KEYS, "time_idx", "region", "pf_rank"],
        "rain",
        {
            "pf_lon": position("lon"),
            "pf_lat": position("lat"),
            "pf_area": F.sum("area_km2"),
            "pf_accumrainheavy": F.sum(F.when(hard, F.col("rain"))),
            **shifts,
        },
    )
    strongest = F.max(
        F.struct("rain", (-F.col("y")).alias("_y"), (-F.col("x")).alias("_x"), "lat", "lon")
    )
    peak = pixels.groupBy(*KEYS).agg(strongest.alias("_p")).select(
        *KEYS, F.col("_p.lat").alias("pf_lat_maxrainrate"), F.col("_p.lon").alias("pf_lon_maxrainrate")
    )
    ellipse = {f"pf_{n}": c for n, c in shapes.shape_columns(pixel_km).items()}
    places = {n: F.bround(m) for n, m in (("_cy", "_my"), ("_cx", "_mx"), ("_hy", "_wy"), ("_hx", "_wx"))}
    for axis, size in wrap.axes() if wrap is not None else ():
        for n in (f"_c{axis}", f"_h{axis}"):
            places[n] = F.pmod(places[n] - F.col(f"_shift_{axis}"), F.lit(float(size)))
    out = (
        moments.withColumns(ellipse)
        .join(length, [*KEYS, "region"])
        .join(peak, KEYS)
        .withColumn("pf_perimeter", F.col("perimeter") * pixel_km)
        .withColumnsRenamed(
            {
                "mean": "pf_rainrate", "peak": "pf_maxrainrate", "total": "pf_accumrain",
                "skewness": "pf_skewness", "npix": "pf_npix",
            }
        )
        .withColumns(places)
        .drop("_mx", "_my", "_vx", "_vy", "_cxy", "_wx", "_wy", "perimeter", "region", *shifts)
    )
    return out, counts


def place_centroids(features: DataFrame, grid: DataFrame) -> DataFrame:
    """Turn centroid pixel addresses into coordinates of those grid cells."""

    def cells(y: str, x: str, name: str) -> DataFrame:
        return grid.select(
            F.col("y").cast("double").alias(y), F.col("x").cast("double").alias(x),
            F.col("lat").alias(f"pf_lat_{name}"), F.col("lon").alias(f"pf_lon_{name}"),
        )

    return (
        features.join(cells("_cy", "_cx", "centroid"), ["_cy", "_cx"], "left")
        .join(cells("_hy", "_hx", "weightedcentroid"), ["_hy", "_hx"], "left")
        .drop("_cy", "_cx", "_hy", "_hx")
    )


def echo_extras(
    pixels: DataFrame, keys: list[str], convective: int, stratiform: int, levels: tuple[int, ...] = (40, 45, 50)
) -> DataFrame:
    """Convective and stratiform rain and area, and strong-echo areas of regions or systems.

    ``pixels`` carry echo_class, rain, area_km2 and dbz_comp.
    """
    conv, strat = F.col("echo_class") == convective, F.col("echo_class") == stratiform
    agg = {}
    for name, where in (("cc", conv), ("sf", strat)):
        agg[f"pf_{name}area"] = F.coalesce(F.sum(F.when(where, F.col("area_km2"))), F.lit(0.0))
        agg[f"pf_{name}rainrate"] = F.avg(F.when(where, F.col("rain")))
        agg[f"pf_{name}rainamount"] = F.sum(F.when(where, F.col("rain")))
    for dbz in levels:
        agg[f"pf_cc{dbz}area"] = F.coalesce(
            F.sum(F.when(F.col("dbz_comp") >= dbz, F.col("area_km2"))), F.lit(0.0)
        )
    return pixels.groupBy(*keys).agg(*[c.alias(n) for n, c in agg.items()])


def core_features(
    pixels: DataFrame,
    ws: Workspace,
    flag: str,
    pixel_km: float,
    keep: int | None = None,
    min_npix: int = 0,
    echo_tops: tuple[int, ...] = (),
    shape: tuple[int, int] | None = None,
    tile: int = label.TILE,
) -> DataFrame:
    """Convective cores per (track, frame) by size (the ``keep`` largest, if asked for): place, area, ellipse, perimeter, echo tops.

    ``pixels`` carry lat, lon, area_km2, dbz_comp and echotopNN; ``flag`` marks core pixels.
    """
    px = pixels.where(F.col(flag) == 1).select(*KEYS, "y", "x")
    regions = ws.write(label.label_regions(px, ws, keys=KEYS, shape=shape, tile=tile), "core_regions")
    ranked = label.rank_regions(regions, min_npix, keys=KEYS).select(
        *KEYS, "region", F.col("feature_id").alias("core_rank")
    )
    chosen = ranked.where(F.col("core_rank") <= keep) if keep else ranked
    chosen = ws.write(regions.join(chosen, [*KEYS, "region"]), "chosen_cores")
    full = chosen.join(pixels, [*KEYS, "y", "x"])
    tops = {f"pf_coremaxechotop{t}": F.max(f"echotop{t}") for t in echo_tops}
    moments = shapes.region_moments(
        full, [*KEYS, "region", "core_rank"], "dbz_comp",
        {"pf_corelon": F.avg("lon"), "pf_corelat": F.avg("lat"), "pf_corearea": F.sum("area_km2"), **tops},
    )
    ellipse = {f"pf_core{n}": c for n, c in shapes.shape_columns(pixel_km).items()}
    length = shapes.perimeters(chosen, KEYS, tile)
    drop = ["_mx", "_my", "_vx", "_vy", "_cxy", "_wx", "_wy", "mean", "peak", "total", "skewness", "region", "perimeter"]
    return (
        moments.withColumns(ellipse)
        .join(length, [*KEYS, "region"])
        .withColumn("pf_coreperimeter", F.col("perimeter") * pixel_km)
        .drop(*drop)
    )
