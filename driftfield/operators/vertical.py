"""Column operators on (frame_id, y, x, z, height_m, ...) rows.

A column holds as many rows as the grid has levels, so windows and groups per
column are small and evenly spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.operators.systems import islands

COLUMN = ["frame_id", "y", "x"]


def echo_layers(df: DataFrame, value: str, thresh: float, gap: int) -> DataFrame:
    """Base and top height of every layer of ``value > thresh`` (layer 0 is the lowest)."""
    hit = islands(df.where(F.col(value) > thresh), COLUMN, "z", gap, "layer")
    return hit.groupBy(*COLUMN, "layer").agg(
        F.min_by("height_m", "z").alias("base_m"), F.max_by("height_m", "z").alias("top_m")
    )


def echo_top(df: DataFrame, value: str, thresh: float, gap: int, out: str = "echotop") -> DataFrame:
    """Top of the lowest layer; columns without echo are absent."""
    hit = islands(df.where(F.col(value) > thresh), COLUMN, "z", gap, "layer")
    return hit.where("layer = 0").groupBy(*COLUMN).agg(F.max_by("height_m", "z").alias(out))


def echo_tops(df: DataFrame, value: str, thresholds: tuple[int, ...], gap: int) -> DataFrame:
    """``echotopNN`` for several thresholds with one window sort per threshold set.

    The column rows are shuffled once; every threshold adds one pair of window
    expressions over the same partitioning.
    """
    w = Window.partitionBy(*COLUMN).orderBy("z")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    flagged = df
    for t in thresholds:
        hit = F.col(value) > t
        last = F.max(F.when(hit, F.col("z"))).over(before)
        flagged = flagged.withColumn(f"_o{t}", F.when(hit & (F.col("z") - last > gap), 1).otherwise(0))
    for t in thresholds:
        flagged = flagged.withColumn(f"_l{t}", F.sum(f"_o{t}").over(w))
    tops = []
    for t in thresholds:
        low = (F.col(value) > t) & (F.col(f"_l{t}") == 0)
        tops.append(F.max(F.when(low, F.struct("z", "height_m")))["height_m"].alias(f"echotop{t}"))
    return flagged.groupBy(*COLUMN).agg(*tops)


def composite(df: DataFrame, value: str, out: str = "dbz_comp", where: Column | None = None) -> DataFrame:
    """Column maximum, optionally over part of the levels."""
    v = F.col(value) if where is None else F.when(where, F.col(value))
    return df.groupBy(*COLUMN).agg(F.max(v).alias(out))


def _simpson(w_fwd, k: Column, last: Column, y: str, x: str) -> Column:
    """Composite Simpson weights on unequal steps, as a per-row contribution.

    Rows at even positions start a parabola over three points; an even number of
    points leaves one interval, integrated with the parabola of the last three.
    """
    y0, y1, y2 = F.col(y), F.lead(y, 1).over(w_fwd), F.lead(y, 2).over(w_fwd)
    h0 = F.lead(x, 1).over(w_fwd) - F.col(x)
    h1 = F.lead(x, 2).over(w_fwd) - F.lead(x, 1).over(w_fwd)
    s = h0 + h1
    pair = s / 6 * (y0 * (2 - h1 / h0) + y1 * s * s / (h0 * h1) + y2 * (2 - h0 / h1))
    p1, p2 = F.lag(y, 1).over(w_fwd), F.lag(y, 2).over(w_fwd)
    g1 = F.col(x) - F.lag(x, 1).over(w_fwd)
    g0 = F.lag(x, 1).over(w_fwd) - F.lag(x, 2).over(w_fwd)
    tail = (
        F.col(y) * (2 * g1 * g1 + 3 * g0 * g1) / (6 * (g0 + g1))
        + p1 * (g1 * g1 + 3 * g0 * g1) / (6 * g0)
        - p2 * g1 * g1 * g1 / (6 * g0 * (g0 + g1))
    )
    two = (F.col(y) + p1) / 2 * g1
    odd_last = last % 2 == 1
    return F.when((k % 2 == 0) & (k + 2 <= last), pair).when(
        odd_last & (k == last), F.when(last == 1, two).otherwise(tail)
    ).otherwise(0.0)


def cold_pool(df: DataFrame, buoyancy: str, thresh: float, min_depth_m: float) -> DataFrame:
    """Depth, base, top and intensity sqrt(-2 int b dz) of the lowest buoyancy-deficit layer.

    Only columns whose lowest level is below the threshold and whose layer is
    deeper than ``min_depth_m`` are returned.
    """
    per_column = Window.partitionBy(*COLUMN)
    up = per_column.orderBy("z")
    surface = F.first(buoyancy).over(up)
    low = islands(
        df.withColumn("_sfc", surface).where((F.col("_sfc") < thresh) & (F.col(buoyancy) < thresh)),
        COLUMN, "z", 1, "layer",
    ).where("layer = 0")
    low = low.withColumns(
        {"_k": F.row_number().over(up) - 1, "_last": F.count(F.lit(1)).over(per_column) - 1}
    )
    low = low.withColumn("_part", _simpson(up, F.col("_k"), F.col("_last"), buoyancy, "height_m"))
    return (
        low.groupBy(*COLUMN)
        .agg(
            F.min_by("height_m", "z").alias("cp_base"),
            F.max_by("height_m", "z").alias("cp_top"),
            F.sum("_part").alias("_integral"),
        )
        .withColumn("cp_depth", F.col("cp_top") - F.col("cp_base"))
        .where(F.col("cp_depth") > min_depth_m)
        .withColumn("cp_intensity", F.when(F.col("_integral") <= 0, F.sqrt(F.col("_integral") * -2.0)))
        .drop("_integral")
    )


def surface_cold_pools(pools: DataFrame, lowest: DataFrame) -> DataFrame:
    """Keep values only where the pool starts at the lowest level height (``zz_bot``)."""
    at_surface = F.col("cp_base") == F.col("zz_bot")
    out = pools.join(lowest, COLUMN)
    return out.select(
        *COLUMN,
        F.when(at_surface, F.col("cp_intensity")).otherwise(0.0).alias("cp_intensity"),
        *[F.when(at_surface, F.col(c)).alias(c) for c in ("cp_depth", "cp_base", "cp_top")],
    )


def melting_height(df: DataFrame, temp_c: str = "temp_c") -> DataFrame:
    """Height of the highest level pair with a 0 C crossing, linear in between."""
    w = Window.partitionBy(*COLUMN).orderBy("z")
    t0, h0 = F.col(temp_c), F.col("height_m")
    t1, h1 = F.lead(temp_c).over(w), F.lead("height_m").over(w)
    height = F.when(t1 == t0, h1).otherwise(h0 + (h1 - h0) / F.nullif(t1 - t0, F.lit(0.0)) * (0.0 - t0))
    crossing = df.withColumns({"_h": height, "_p": t0 * t1}).where("_p <= 0")
    return crossing.groupBy(*COLUMN).agg(F.max_by("_h", "z").alias("melting_height"))


def interpolate_levels(df: DataFrame, value: str, levels_m: list[float], linear_z: bool = True) -> DataFrame:
    """Values at fixed heights, linear in height (reflectivity in linear units)."""
    w = Window.partitionBy(*COLUMN).orderBy("z")
    v = F.pow(F.lit(10.0), F.col(value) / 10) if linear_z else F.col(value)
    rows = df.withColumn("_v", v).withColumns(
        {"_h1": F.lead("height_m").over(w), "_v1": F.lead("_v").over(w)}
    )
    hit = rows.withColumn("level_m", F.explode(F.array(*[F.lit(float(h)) for h in levels_m]))).where(
        (F.col("level_m") >= F.col("height_m")) & (F.col("level_m") < F.col("_h1"))
    )
    at = F.col("_v") + (F.col("_v1") - F.col("_v")) * (F.col("level_m") - F.col("height_m")) / (
        F.col("_h1") - F.col("height_m")
    )
    return hit.select(*COLUMN, "level_m", (F.log10(at) * 10 if linear_z else at).alias(value))


def accumulated_to_rate(df: DataFrame, value: str, time_s: str = "epoch_s", out: str = "rainrate") -> DataFrame:
    """Hourly rate from a running accumulation; the value belongs to the later time."""
    w = Window.partitionBy("y", "x").orderBy(time_s)
    step = F.col(time_s) - F.lag(time_s).over(w)
    rate = (F.col(value) - F.lag(value).over(w)) * 3600.0 / step
    return df.withColumn(out, rate).where(F.col(out).isNotNull())
