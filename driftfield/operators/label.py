"""Labelling: connected regions per frame, size filter and size ranking."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.operators.components import connected_components, hook
from driftfield.operators.ranking import bucketed_row_number
from driftfield.operators.tiles import TILE, Wrap, with_tiles
from driftfield.workspace import Workspace

ROOT_SHIFT = 32


def raster_key(y: Column | str = "y", x: Column | str = "x") -> Column:
    """Pixel address that sorts in raster order."""
    y = F.col(y) if isinstance(y, str) else y
    x = F.col(x) if isinstance(x, str) else x
    return F.shiftleft(y.cast("long"), ROOT_SHIFT) + x.cast("long")


def region_roots(y: np.ndarray, x: np.ndarray, split: np.ndarray | None = None) -> np.ndarray:
    """Index of each pixel's first raster pixel within its 4-connected region.

    ``y, x`` must be in raster order.  ``split`` separates touching pixels that
    carry different values (regions grow only inside one value).
    """
    n = len(y)
    y = y - y.min()
    x = x - x.min()
    slot = np.full((y.max() + 2, x.max() + 2), -1, dtype=np.int64)
    slot[y, x] = np.arange(n)
    a, b = [], []
    for other in (slot[y + 1, x], slot[y, x + 1]):
        touch = other >= 0
        here, there = np.nonzero(touch)[0], other[touch]
        if split is not None:
            same = split[here] == split[there]
            here, there = here[same], there[same]
        a.append(here)
        b.append(there)
    return hook(n, np.concatenate(a), np.concatenate(b))


def label_regions(
    pixels: DataFrame,
    ws: Workspace,
    keys: Sequence[str] = ("frame_id",),
    within: str | None = None,
    tile: int = TILE,
    shape: tuple[int, int] | None = None,
    periodic_y: bool = False,
    periodic_x: bool = False,
    wrap: Wrap | None = None,
) -> DataFrame:
    """Add ``region``: the raster key of the first pixel of the 4-connected region.

    Regions are found tile by tile; the few pairs that touch across tile edges
    (or across a periodic domain edge) are merged by ``connected_components``.
    ``shape`` is the grid size (ny, nx): needed for periodic edges, and when the
    grid fits one tile the merge step is left out of the plan altogether.
    ``within`` names a column whose equal values bound regions.  ``wrap`` gives shape and
    periodic edges at once.
    """
    keys = list(keys)
    if wrap is not None:
        shape, periodic_y, periodic_x = wrap.shape, wrap.y, wrap.x
    if (periodic_x or periodic_y) and shape is None:
        raise ValueError("periodic labelling needs the grid shape")
    schema = T.StructType([*pixels.schema.fields, T.StructField("region", T.LongType())])
    columns = pixels.columns

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        y = pdf["y"].to_numpy(np.int64)
        x = pdf["x"].to_numpy(np.int64)
        root = region_roots(y, x, pdf[within].to_numpy() if within else None)
        return pdf[columns].assign(region=(y[root] << ROOT_SHIFT) + x[root])

    local = with_tiles(pixels, tile).groupBy(*keys, "_ty", "_tx").applyInPandas(kernel, schema)
    one_tile = shape is not None and max(shape) <= tile
    if one_tile and not (periodic_x or periodic_y):
        return local

    local = ws.write(local, "tile_regions")
    ny, nx = shape if shape else (None, None)
    same = [*keys] + ([within] if within else [])
    edge = [*same, "y", "x", "region"]
    pairs = []
    if not one_tile:
        pairs.append((F.col("y") % tile == 0, F.col("y") % tile == tile - 1, F.col("y") - 1, F.col("x")))
        pairs.append((F.col("x") % tile == 0, F.col("x") % tile == tile - 1, F.col("y"), F.col("x") - 1))
    if periodic_y:
        pairs.append((F.col("y") == 0, F.col("y") == ny - 1, F.lit(ny - 1), F.col("x")))
    if periodic_x:
        pairs.append((F.col("x") == 0, F.col("x") == nx - 1, F.col("y"), F.lit(nx - 1)))
    touching = None
    for low_side, high_side, other_y, other_x in pairs:
        low = local.where(low_side).select(
            *same, other_y.cast("int").alias("y"), other_x.cast("int").alias("x"), F.col("region").alias("src")
        )
        high = local.where(high_side).select(*edge).withColumnRenamed("region", "dst")
        hit = low.join(high, [*same, "y", "x"]).select(*keys, "src", "dst")
        touching = hit if touching is None else touching.unionByName(hit)
    merged = connected_components(touching.distinct(), ws, keys).select(
        *keys, F.col("node").alias("region"), "component"
    )
    return (
        local.join(merged, [*keys, "region"], "left")
        .withColumn("region", F.coalesce("component", "region"))
        .select(*columns, "region")
    )


def size_bucket(npix: str) -> Column:
    """Ascending bucket of descending size: exact up to 64 pixels, logarithmic above."""
    n = F.col(npix).cast("double")
    return -F.when(n <= 64, n).otherwise(64 + F.floor(8 * F.log2(n / 64))).cast("int")


def rank_regions(
    labelled: DataFrame,
    min_npix: float | None = None,
    min_area: float | None = None,
    area_col: str | None = None,
    keys: Sequence[str] = ("frame_id",),
) -> DataFrame:
    """Features ranked by size: (keys, region, feature_id, npix, area).

    The size filter is strict (``>``), by pixels or by summed area; the rank is
    always by pixels, ties by the later region first.
    """
    keys = list(keys)
    area = F.sum(area_col) if area_col else F.count(F.lit(1)).cast("double")
    sizes = labelled.groupBy(*keys, "region").agg(
        F.count(F.lit(1)).alias("npix"), area.alias("area")
    )
    if min_npix is not None:
        sizes = sizes.where(F.col("npix") > min_npix)
    if min_area is not None:
        sizes = sizes.where(F.col("area") > min_area)
    ranked = bucketed_row_number(
        sizes,
        keys,
        {
            "_size": size_bucket("npix"),
            "_rows": F.when(F.col("npix") <= 64, -F.shiftright("region", ROOT_SHIFT + 9)).otherwise(0),
        },
        [F.desc("npix"), F.desc("region")],
        "feature_id",
    )
    return ranked.withColumn("feature_id", F.col("feature_id").cast("int"))


def renumber(
    labelled: DataFrame, ranked: DataFrame, keys: Sequence[str] = ("frame_id",)
) -> DataFrame:
    """Replace ``region`` by the size rank; pixels of dropped regions disappear."""
    keys = list(keys)
    return labelled.join(ranked.select(*keys, "region", "feature_id"), [*keys, "region"]).drop("region")


def renumber_pair(
    labels: DataFrame,
    primary: str,
    secondary: str,
    min_npix: float | None = None,
    min_area: float | None = None,
    area_col: str | None = None,
    keys: Sequence[str] = ("frame_id",),
) -> tuple[DataFrame, DataFrame]:
    """Renumber two label columns by the size rank of the first one.

    Returns (labels, features).  Numbers of the secondary column that have no
    kept primary feature become 0.
    """
    keys = list(keys)
    base = labels.where(F.col(primary) > 0).withColumn("region", F.col(primary).cast("long"))
    features = rank_regions(base, min_npix, min_area, area_col, keys)
    first = features.select(*keys, F.col("region").alias(primary), F.col("feature_id").alias("_p"))
    second = features.select(*keys, F.col("region").alias(secondary), F.col("feature_id").alias("_s"))
    out = (
        labels.withColumns({primary: F.col(primary).cast("long"), secondary: F.col(secondary).cast("long")})
        .join(first, [*keys, primary], "left")
        .join(second, [*keys, secondary], "left")
        .withColumn(primary, F.coalesce("_p", F.lit(0)))
        .withColumn(secondary, F.coalesce("_s", F.lit(0)))
        .drop("_p", "_s")
    )
    return out, features
