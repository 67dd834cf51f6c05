"""Climatology aggregates over pixels and track statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_map(
    pixels: DataFrame, frames: DataFrame, time_key: str, rain: str = "rain", rain_min: float | None = None, hours: float = 1.0
) -> DataFrame:
    """Rain totals and system counts per (time_key, y, x), with the number of frames behind them.

    ``pixels`` carry frame_id, time_key, rain, cloudtracknumber and pcptracknumber (0 = none);
    ``frames`` has a row per frame with its time_key.
    """
    r = F.col(rain) * hours
    cloud, wet = F.col("cloudtracknumber") > 0, F.col("pcptracknumber") > 0
    agg = [
        F.coalesce(F.sum(r), F.lit(0.0)).alias("precipitation"),
        F.coalesce(F.sum(F.when(cloud, r)), F.lit(0.0)).alias("mcs_precipitation"),
        F.sum(cloud.cast("int")).alias("mcs_cloud_count"),
        F.sum(wet.cast("int")).alias("mcs_precipitation_count"),
    ]
    if rain_min is not None:
        agg.append(F.sum((F.col(rain) > rain_min).cast("int")).alias("precipitation_count"))
    maps = pixels.groupBy(time_key, "y", "x").agg(*agg)
    return maps.join(frames.groupBy(time_key).agg(F.count(F.lit(1)).alias("ntimes")), time_key)


def hovmoller(pixels: DataFrame, band: Column | None = None, rain: str = "rain") -> DataFrame:
    """Mean rain per (frame, x) over a latitude band, in all and inside systems (0 elsewhere)."""
    px = pixels.where(band) if band is not None else pixels
    inside = F.when(F.col("pcptracknumber") > 0, F.col(rain)).when(F.col(rain).isNotNull(), 0.0)
    return px.groupBy("frame_id", "x").agg(
        F.avg(rain).alias("precipitation"), F.avg(inside).alias("mcs_precipitation")
    )


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """0-based bin, right-open with a closed last bin; NULL outside."""
    at = sum((value >= float(e)).cast("int") for e in edges) - 1
    return F.when((value < float(edges[0])) | (value > float(edges[-1])), F.lit(None)).otherwise(
        F.least(at, F.lit(len(edges) - 2))
    )


def rain_histograms(
    pixels: DataFrame,
    edges: Sequence[float],
    land: Column,
    ocean: Column,
    cold_tb: float = 310.0,
    light: float = 0.5,
    rain: str = "rain",
) -> DataFrame:
    """Counts per (category, surface, bin): total, system, isolated deep and congestus rain.

    One pass: each pixel lists its categories, and the counts are partially
    aggregated before they are shuffled.
    """
    deep = F.col("cloudnumber") > 0
    in_system = F.col("cloudtracknumber") > 0
    kinds = F.array_compact(
        F.array(
            F.lit("total"),
            F.when(in_system, "mcs"),
            F.when(deep & ~in_system, "idc"),
            F.when(~deep & (F.col("tb") < cold_tb) & (F.col(rain) > light), "congestus"),
        )
    )
    surface = F.array_compact(F.array(F.when(land, "land"), F.when(ocean, "ocean")))
    return (
        pixels.withColumn("bin", bin_index(F.col(rain), edges))
        .where("bin is not null")
        .withColumn("category", F.explode(kinds))
        .withColumn("surface", F.explode(surface))
        .groupBy("category", "surface", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def normalise_histograms(hist: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Adds pdf, rain amount per bin and its running sum along the bins."""
    group = Window.partitionBy("category", "surface")
    left = F.array(*[F.lit(float(e)) for e in edges])
    amount = F.col("n") * F.element_at(left, F.col("bin") + 1)
    return (
        hist.withColumn("pdf", F.col("n") / F.sum("n").over(group))
        .withColumn("amount", amount)
        .withColumn("cum_amount", F.sum("amount").over(group.orderBy("bin")))
    )


def statistics_map(pixels: DataFrame, stats: DataFrame, values: Sequence[str], period: str) -> DataFrame:
    """Track statistics laid out on the pixels their system covered.

    ``pixels``: track_id, frame_id, y, x, wet (inside the rain mask).  ``stats``:
    track_id, frame_id, time_idx, period, starts (initiated, not split),
    ccs_area, pf_area and ``values``.  Means divide by the hours a pixel was
    covered; initiation counts the first time only.
    """
    px = pixels.join(stats, ["track_id", "frame_id"])
    wet = F.col("wet")
    sums = ["ccs_area", "pf_area", *values]
    # a row per track first: what follows counts tracks without distinct aggregates
    per_track = px.groupBy(period, "y", "x", "track_id").agg(
        F.count(F.lit(1)).alias("hours"),
        F.sum(wet.cast("int")).alias("wet_hours"),
        F.sum((F.col("starts") & (F.col("time_idx") == 0)).cast("int")).alias("starts"),
        *[F.sum(F.when(wet | F.lit(v == "ccs_area"), F.col(v))).alias(v) for v in sums],
    )
    hours, wet_hours = F.sum("hours"), F.nullif(F.sum("wet_hours"), F.lit(0))
    return per_track.groupBy(period, "y", "x").agg(
        hours.alias("nhour_ccs"),
        F.sum("wet_hours").alias("nhour_pf"),
        F.count(F.lit(1)).alias("nmcs_ccs"),
        F.sum((F.col("wet_hours") > 0).cast("int")).alias("nmcs_pf"),
        F.sum("starts").alias("initiation"),
        (F.coalesce(F.sum("ccs_area"), F.lit(0.0)) / hours).alias("ccs_area"),
        *[(F.coalesce(F.sum(v), F.lit(0.0)) / wet_hours).alias(v) for v in sums[1:]],
    )


def lifetime_map(
    pixels: DataFrame, lifetimes: DataFrame, period: str, points: Sequence[float] = (0.5, 0.75, 0.9, 0.95)
) -> DataFrame:
    """Mean and percentiles of the lifetimes of the systems that ever covered a pixel.

    Each system counts once per pixel, so a pixel gathers at most as many values
    as there are systems in the period.
    """
    covers = pixels.select("track_id", "y", "x").distinct().join(lifetimes.select("track_id", "lifetime", period), "track_id")
    pct = F.percentile("lifetime", F.array(*[F.lit(float(p)) for p in points]))
    out = covers.groupBy(period, "y", "x").agg(F.avg("lifetime").alias("lifetime_mean"), pct.alias("_p"))
    return out.select(
        period, "y", "x", "lifetime_mean",
        *[F.col("_p")[i].alias(f"lifetime_p{round(p * 100)}") for i, p in enumerate(points)],
    )


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")
    )


def diurnal_cycle(rows: DataFrame, keys: Sequence[str], hour: Column, value: str) -> DataFrame:
    return rows.groupBy(*keys, hour.cast("int").alias("hour")).agg(F.avg(value).alias(value))


def harmonics(cycle: DataFrame, keys: Sequence[str], steps: int, count: int, first_hour: float = 0.0, bin_h: float = 1.0, value: str = "value") -> DataFrame:
    """Amplitude, peak time and explained variance [%] of the first harmonics.

    ``cycle`` holds keys, hour (0..steps-1) and value; the transform is a sum of
    cosines and sines, so it aggregates like any other sum.
    """
    h, v = F.col("hour"), F.col(value)
    sums = [F.sum(v * v).alias("_vv"), F.sum(v).alias("_v")]
    for n in range(1, count + 1):
        angle = h * (2 * math.pi * n / steps)
        sums += [F.sum(v * F.cos(angle)).alias(f"_c{n}"), (-F.sum(v * F.sin(angle))).alias(f"_s{n}")]
    rows = cycle.groupBy(*keys).agg(*sums)
    # all non-constant harmonics together, from the sum of squares
    total = (F.col("_vv") * steps - F.col("_v") * F.col("_v")) * (2.0 / (steps * steps))
    parts = []
    for n in range(1, count + 1):
        re, im = F.col(f"_c{n}"), F.col(f"_s{n}")
        amp = F.sqrt(re * re + im * im) * (2.0 / steps)
        top = steps * bin_h / n
        raw = F.lit(top + first_hour) - F.atan2(im, re) * (steps * bin_h / (2 * math.pi) / n)
        once = F.when(raw > top, raw - top).otherwise(raw)
        phase = F.when(once < 0, once + top).otherwise(once)
        share = F.when(total < 1e-12, 0.0).otherwise(amp * amp * 50.0 / total)
        parts.append(F.struct(F.lit(n).alias("harmonic"), amp.alias("amplitude"), phase.alias("phase"), share.alias("variance")))
    return rows.withColumn("_h", F.explode(F.array(*parts))).select(*keys, "_h.*")


def kernel_density(rows: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], bandwidth: float) -> DataFrame:
    """Gaussian density at fixed points: one partial average per point, no row expansion."""
    norm = 1.0 / (bandwidth * math.sqrt(2 * math.pi))
    v = F.col(value).cast("double")
    dens = [
        (F.avg(F.exp((v - float(p)) * (v - float(p)) * (-0.5 / bandwidth**2))) * norm).alias(f"_d{i}")
        for i, p in enumerate(points)
    ]
    table = rows.where(v.isNotNull()).groupBy(*keys).agg(*dens)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("point"), F.col(f"_d{i}").alias("density")) for i, p in enumerate(points)])
    return table.withColumn("_p", F.explode(pairs)).select(*keys, "_p.*")


def occurrence_frequency(pixels: DataFrame, mask: Column) -> DataFrame:
    """Share of all frames in which the mask holds, per pixel."""
    frames = pixels.select("frame_id").distinct().agg(F.count(F.lit(1))).scalar()
    counts = pixels.groupBy("y", "x").agg(F.sum(F.coalesce(mask.cast("int"), F.lit(0))).alias("_k"))
    return counts.select("y", "x", (F.col("_k") / frames).alias("frequency"))


def tracks_in_region(
    stats: DataFrame, lat: tuple[float, float], lon: tuple[float, float], min_hours: float, months: Sequence[int], month: Column, dt_h: float
) -> DataFrame:
    """Tracks whose mean position lies in the box, that last long enough and start in the months."""
    mean = stats.groupBy("track_id").agg(
        F.avg("meanlat").alias("_lat"), F.avg("meanlon").alias("_lon"),
        (F.count(F.lit(1)) * dt_h).alias("lifetime"), F.min_by(month, F.col("time_idx")).alias("start_month"),
    )
    return mean.where(
        F.col("_lat").between(*lat) & F.col("_lon").between(*lon) & (F.col("lifetime") >= min_hours)
        & F.col("start_month").isin(*months)
    ).select("track_id", "lifetime", "start_month")


def land_or_ocean(stats: DataFrame, land_min: float, ocean_max: float) -> DataFrame:
    """Surface class of a track by its mean land fraction."""
    frac = stats.groupBy("track_id").agg(F.avg("pf_landfrac").alias("landfrac"))
    return frac.withColumn(
        "surface", F.when(F.col("landfrac") >= land_min, "land").when(F.col("landfrac") <= ocean_max, "ocean").otherwise("mixed")
    )


def merge_split_class(ends: DataFrame) -> DataFrame:
    """Whether a track starts by a split or ends by a merge, both or neither."""
    split, merge = F.col("start_split_tracknumber").isNotNull(), F.col("end_merge_tracknumber").isNotNull()
    kind = F.when(split & merge, "both").when(split, "split").when(merge, "merge").otherwise("neither")
    return ends.select("track_id", kind.alias("kind"))


def tracks_ever(stats: DataFrame, condition: Column) -> DataFrame:
    """Tracks for which the condition holds at any time."""
    return stats.groupBy("track_id").agg(F.max(condition).alias("_any")).where("_any").select("track_id")
