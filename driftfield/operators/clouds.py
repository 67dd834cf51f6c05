"""Cold-cloud identification: seeded growth, cold-area detection, rain linking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.functions import physics
from driftfield.operators import image, label
from driftfield.operators.components import connected_components
from driftfield.operators.tiles import Wrap
from driftfield.workspace import Workspace

PIXEL = ["frame_id", "y", "x"]


def _regions(px: DataFrame, ws: Workspace, shape, tile: int, wrap: Wrap | None, name: str) -> DataFrame:
    return ws.write(label.label_regions(px, ws, shape=shape, tile=tile, wrap=wrap), name)


def _ranked_labels(px: DataFrame, ws: Workspace, shape, tile: int, wrap: Wrap | None, **limits) -> DataFrame:
    regions = _regions(px, ws, shape, tile, wrap, "cloud_regions")
    return label.renumber(regions, label.rank_regions(regions, **limits)).select(*PIXEL, "feature_id")


def grow_cold_clouds(
    df: DataFrame,
    ws: Workspace,
    thresholds: tuple[float, float, float, float],
    min_area: float,
    min_core_npix: int,
    smooth_size: int,
    shape: tuple[int, int],
    warm_expansion: bool = False,
    area_col: str = "area_km2",
    tile: int = image.TILE,
    carry: tuple[str, ...] = (),
    wrap: Wrap | None = None,
) -> DataFrame:
    """Clouds grown from cold cores of the smoothed temperature, plus isolated cold areas.

    ``df``: frame_id, y, x, tb, area_km2 with one row per observed pixel.
    Thresholds are core, cold, warm and cloud.  A frame without any core keeps
    its cold areas instead.  Result: cloudtype, convcold_cloudnumber (core and
    cold part) and cloudnumber (with the warm part); 0 where there is no cloud.
    Columns in ``carry`` are kept.  ``wrap`` tells which edges of the grid meet.
    """
    core_t, cold_t, warm_t, cloud_t = thresholds
    tb = F.col("tb")
    kept = dict.fromkeys([*PIXEL, "tb", area_col, *carry])
    base = df.select(*kept).withColumn("cloudtype", physics.cloud_type("tb", core_t, cold_t, warm_t, cloud_t))
    base = ws.write(base, "cloud_pixels")
    smooth = image.smooth_box(base.select(*PIXEL, "tb"), "tb", smooth_size, shape, tile=tile, wrap=wrap)
    cores_px = ws.write(smooth.where(F.col("smooth") < core_t).select(*PIXEL), "core_pixels")
    cored = cores_px.select("frame_id").distinct().withColumn("_cored", F.lit(True))
    cores = ws.write(_ranked_labels(cores_px, ws, shape, tile, wrap, min_npix=min_core_npix), "cores")

    state = (
        base.join(cored, "frame_id", "left")
        .join(cores.withColumnRenamed("feature_id", "core_id"), PIXEL, "left")
        .withColumn("core_id", F.coalesce("core_id", F.lit(0)))
        .withColumn("_open", tb <= cold_t)
        .withColumn("seed", F.when(F.col("_open"), F.col("core_id")).otherwise(0))
    )
    grown = image.grow_labels(state.select(*PIXEL, "_open", "seed"), ws, "seed", "_open", "vote", tile, wrap=wrap)
    state = ws.write(
        state.drop("seed").join(grown.select(*PIXEL, "seed"), PIXEL)
        .withColumn("number", F.when(F.col("_open"), F.col("seed")).otherwise(F.col("core_id")))
        .drop("seed", "_open", "core_id"),
        "grown_clouds",
    )

    left_over = state.where(F.col("_cored") & (F.col("number") == 0) & (tb < cold_t))
    isolated = _ranked_labels(left_over.select(*PIXEL, area_col), ws, shape, tile, wrap, min_area=min_area, area_col=area_col)
    ncores = cores.groupBy("frame_id").agg(F.max("feature_id").alias("_n"))
    isolated = isolated.join(ncores, "frame_id", "left").select(
        *PIXEL, (F.col("feature_id") + F.coalesce("_n", F.lit(0))).alias("region")
    )
    with_core = state.where("number > 0").select(*PIXEL, F.col("number").alias("region")).unionByName(isolated)
    with_core = ws.write(with_core.withColumn("region", F.col("region").cast("long")), "numbered_clouds")
    first = label.renumber(with_core, label.rank_regions(with_core))

    plain = state.where(F.col("_cored").isNull() & (F.col("cloudtype") == physics.COLD))
    regions = _regions(plain.select(*PIXEL, area_col), ws, shape, tile, wrap, "plain_regions")
    big = regions.groupBy("frame_id", "region").agg(F.sum(area_col).alias("_a")).where(F.col("_a") >= min_area)
    large = regions.join(big.select("frame_id", "region"), ["frame_id", "region"], "left_semi").select(*PIXEL, "region")
    second = label.renumber(large, label.rank_regions(large))

    numbers = first.unionByName(second).withColumnRenamed("feature_id", "convcold_cloudnumber")
    out = (
        state.select(*kept, "cloudtype")
        .join(numbers, PIXEL, "left")
        .withColumn("convcold_cloudnumber", F.coalesce("convcold_cloudnumber", F.lit(0)))
        .withColumn("cloudnumber", F.col("convcold_cloudnumber"))
    )
    if not warm_expansion:
        return out
    return expand_warm(ws.write(out, "clouds"), ws, warm_t, tile, wrap)


def expand_warm(
    clouds: DataFrame, ws: Workspace, warm_t: float, tile: int = image.TILE, wrap: Wrap | None = None
) -> DataFrame:
    """Grow cloudnumber ring by ring into pixels warmer than the cloud but below the warm limit."""
    px = clouds.select(*PIXEL, "cloudnumber", (F.col("tb") < warm_t).alias("_open"))
    warm = image.grow_labels(px, ws, "cloudnumber", "_open", "first", tile, wrap=wrap)
    return clouds.drop("cloudnumber").join(warm.select(*PIXEL, "cloudnumber"), PIXEL)


def detect_and_spread(
    df: DataFrame,
    ws: Workspace,
    thresholds: tuple[float, float, float, float],
    min_area: float,
    shape: tuple[int, int],
    warm_expansion: bool = True,
    area_col: str = "area_km2",
    tile: int = image.TILE,
    wrap: Wrap | None = None,
) -> DataFrame:
    """Cold areas above the size limit, numbered by size, optionally spread into warm cloud."""
    core_t, cold_t, warm_t, cloud_t = thresholds
    base = ws.write(
        df.select(*PIXEL, "tb", area_col).withColumn("cloudtype", physics.cloud_type("tb", core_t, cold_t, warm_t, cloud_t)),
        "cloud_pixels",
    )
    cold = base.where(F.col("tb") < cold_t).select(*PIXEL, area_col)
    numbers = _ranked_labels(cold, ws, shape, tile, wrap, min_area=min_area, area_col=area_col)
    out = (
        base.join(numbers.withColumnRenamed("feature_id", "convcold_cloudnumber"), PIXEL, "left")
        .withColumn("convcold_cloudnumber", F.coalesce("convcold_cloudnumber", F.lit(0)))
        .withColumn("cloudnumber", F.col("convcold_cloudnumber"))
    )
    return expand_warm(ws.write(out, "clouds"), ws, warm_t, tile, wrap) if warm_expansion else out


def cloud_counts(clouds: DataFrame) -> DataFrame:
    """Core, cold and warm pixel counts per cloud."""
    kind = F.col("cloudtype")
    cold_part = F.col("convcold_cloudnumber") > 0
    return clouds.where("cloudnumber > 0").groupBy("frame_id", F.col("cloudnumber").alias("feature_id")).agg(
        F.sum((cold_part & (kind == physics.CORE)).cast("int")).alias("ncorepix"),
        F.sum((cold_part & (kind == physics.COLD)).cast("int")).alias("ncoldpix"),
        F.sum((~cold_part).cast("int")).alias("nwarmpix"),
    )


def link_rain_clouds(df: DataFrame, ws: Workspace, skip_last: bool = True) -> DataFrame:
    """Give all clouds under one rain feature the number of the largest of them.

    ``df``: frame_id, y, x, convcold_cloudnumber, cloudnumber, pf_number (0 =
    none).  Rain features are taken in ascending number; a cloud is renumbered
    once; rain pixels without cloud join the cloud of their rain feature.  With
    ``skip_last`` the highest-numbered rain feature of a frame has no effect.

    The order only matters within a cluster of rain features and clouds that
    touch, so the pixels are first reduced to (rain feature, cloud) pairs and the
    ordered pass runs per cluster on those pairs.
    """
    cloud, rain = "convcold_cloudnumber", "pf_number"
    sizes = df.where(f"{cloud} > 0").groupBy("frame_id", cloud).agg(F.count(F.lit(1)).alias("npix"))
    touch = df.where(f"{rain} > 0").groupBy("frame_id", rain, cloud).agg(F.count(F.lit(1)).alias("shared"))
    if skip_last:
        last = touch.groupBy("frame_id").agg(F.max(rain).alias("_last"))
        touch = touch.join(last, "frame_id").where(F.col(rain) < F.col("_last")).drop("_last")
    touch = ws.write(touch, "rain_cloud_pairs")
    pairs = touch.where(f"{cloud} > 0")
    nodes = pairs.select(
        "frame_id", (F.col(rain) * 2 + 1).cast("long").alias("src"), (F.col(cloud) * 2).cast("long").alias("dst")
    )
    clusters = connected_components(nodes, ws, ["frame_id"])
    open_px = touch.where(f"{cloud} = 0").select("frame_id", rain, F.col("shared").alias("bare"))
    of_rain = clusters.where("node % 2 = 1").select(
        "frame_id", ((F.col("node") - 1) / 2).cast("int").alias(rain), F.col("component").alias("cluster")
    )
    rows = (
        pairs.join(of_rain, ["frame_id", rain])
        .join(sizes, ["frame_id", cloud])
        .join(open_px, ["frame_id", rain], "left")
        .select(
            "frame_id", "cluster", F.col(rain).cast("int").alias("rain"), F.col(cloud).cast("int").alias("cloud"),
            "npix", F.coalesce("bare", F.lit(0)).alias("bare"),
        )
    )

    def ordered_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(pdf["cloud"], pdf["npix"]))
        own = dict(size)
        number = {c: c for c in size}
        settled: set[int] = set()
        filled = []
        for rain_id, part in pdf.sort_values("rain").groupby("rain"):
            seen = sorted({number[c] for c in part["cloud"]})
            target = max(seen, key=lambda n: (size[n], -n))
            for n in seen:
                if n not in settled:
                    settled.add(n)
                    number[n] = target
                    size[n] -= own[n]
                    size[target] += own[n]
            size[target] += int(part["bare"].iat[0])
            filled.append((rain_id, target))
        frame = pdf["frame_id"].iat[0]
        rows_ = [(frame, 0, c, n) for c, n in number.items()] + [(frame, 1, r, n) for r, n in filled]
        return pd.DataFrame(rows_, columns=["frame_id", "kind", "id", "target"])

    moves = ws.write(
        rows.groupBy("frame_id", "cluster").applyInPandas(ordered_pass, "frame_id long, kind int, id int, target int"),
        "cloud_moves",
    )
    cloud_to = moves.where("kind = 0").select("frame_id", "id", "target")
    rain_to = moves.where("kind = 1").select("frame_id", F.col("id").alias(rain), F.col("target").alias("_fill"))
    out = df.join(rain_to, ["frame_id", rain], "left")
    for col in (cloud, "cloudnumber"):
        to = cloud_to.select("frame_id", F.col("id").alias(col), F.col("target").alias("_to"))
        renumbered = F.when(F.col(col) > 0, F.coalesce("_to", col)).otherwise(F.coalesce("_fill", F.lit(0)))
        out = out.join(to, ["frame_id", col], "left").withColumn(f"pf_{col}", renumbered.cast("int")).drop("_to")
    return out.drop("_fill")
