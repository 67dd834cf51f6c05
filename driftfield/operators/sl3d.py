"""Three-dimensional echo classes from reflectivity columns.

Columns are packed to one array per pixel (as long as the grid has levels), so a
halo tile holds complete columns and every neighbourhood test stays local.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.operators.image import Patch
from driftfield.operators.tiles import TILE, tile_apply, tile_box

# fixed values: class numbers
NO_ECHO, UPDRAFT, CONVECTION, RAIN_STRATIFORM, DRY_STRATIFORM, ANVIL = range(6)


# fixed values: limits of the published classification
@dataclass(frozen=True)
class EchoLimits:
    box_px: int = 3
    gap_fill_dbz: float = 20.0
    strat_3km_dbz: float = 20.0
    strat_low_dbz: float = 10.0
    peaked_share: float = 0.3
    above_melting_dbz: float = 45.0
    echo_top_km: float = 10.0
    neighbour_dbz: float = 25.0
    updraft_gradient_db: float = 8.0
    updraft_max_km: float = 7.0
    updraft_dbz: float = 40.0


def _windows(a: np.ndarray, r: int) -> np.ndarray:
    """(2r+1)^2 boxes around each cell, edges mirrored."""
    padded = np.pad(a, r, mode="symmetric")
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * r + 1, 2 * r + 1))


_ROWS_AT_ONCE = 1 << 20


def _middle(a: np.ndarray, r: int) -> np.ndarray:
    """Median of the box around each cell, missing values counted as the largest; some rows at a time."""
    box = _windows(a, r)
    size = box.shape[2] * box.shape[3]
    step = max(1, _ROWS_AT_ONCE // max(1, size * a.shape[1]))
    parts = [
        np.partition(box[k : k + step].reshape(-1, a.shape[1], size), size // 2, axis=2)[:, :, size // 2]
        for k in range(0, a.shape[0], step)
    ]
    return np.concatenate(parts)


def _share(flag: np.ndarray, mode: str = "edge") -> np.ndarray:
    padded = np.pad(flag.astype(float), 1, mode=mode)
    return np.lib.stride_tricks.sliding_window_view(padded, (3, 3)).mean(axis=(2, 3))


def classify_columns(v: np.ndarray, km: np.ndarray, melt: np.ndarray, lim: EchoLimits) -> np.ndarray:
    """Classes of a (z, y, x) block; ``v`` NaN where there is no echo, ``melt`` [km] per cell."""
    v = v.copy()
    nz = len(km)

    def level(h: float) -> int:
        return max(int(np.searchsorted(km, h, side="right")) - 1, 0)

    k3, k4, k5, k9 = (level(h) for h in (3.0, 4.0, 5.0, 9.0))
    gap = ~np.isfinite(v[k3]) & (np.nan_to_num(v[k4], nan=-np.inf) >= lim.gap_fill_dbz)
    v[k3][gap] = v[k4][gap]
    echo = np.isfinite(v)
    low = np.nan_to_num(v, nan=-np.inf)
    depth = (low[k3:] >= 0).sum(axis=0)
    zz = km[:, None, None]
    top25 = ((low >= 25) * zz).max(axis=0)
    peak = np.where(echo.any(axis=0), low.max(axis=0), -np.inf)
    above = np.where(zz > melt[None] + 1.0, low, np.where(echo, 0.0, -np.inf)).max(axis=0)

    counts = np.zeros(v.shape[1:])
    levels = np.zeros(v.shape[1:])
    for k in range(k9 + 1):
        middle = _middle(v[k], lim.box_px)
        need = np.maximum(10.0 - v[k] ** 2 / 337.5, 4.0)
        counts += np.nan_to_num(v[k] - middle, nan=-np.inf) > np.nan_to_num(need, nan=np.inf)
        levels += echo[k]
    share = np.divide(counts, levels, out=np.zeros_like(counts), where=levels > 0)

    cls = np.zeros(v.shape[1:], dtype=int)
    cls[(levels > 0) & (share >= lim.peaked_share)] = CONVECTION
    cls[(above >= lim.above_melting_dbz) | (top25 >= lim.echo_top_km)] = CONVECTION
    cls[(cls == CONVECTION) & (_share(cls == CONVECTION) <= 0.15)] = NO_ECHO
    cls[(_share(cls == CONVECTION) > 0.001) & (peak >= lim.neighbour_dbz)] = CONVECTION
    rain = (low[k3] >= lim.strat_3km_dbz) | (low[:k3] >= lim.strat_low_dbz).any(axis=0)
    cls[rain & (cls == NO_ECHO)] = RAIN_STRATIFORM
    cls[(low[k3] < lim.strat_3km_dbz) & (depth > 0) & (cls == NO_ECHO)] = DRY_STRATIFORM
    hollow = ~echo[k3:k5 + 1].any(axis=0)
    cls[hollow & (depth > 0) & np.isin(cls, (NO_ECHO, DRY_STRATIFORM))] = ANVIL

    rising = np.roll(v, -1, axis=0) - v
    near = np.stack([_share(echo[k], "symmetric") for k in range(nz)])
    weak = (np.nan_to_num(rising, nan=-np.inf) >= lim.updraft_gradient_db) & (near >= 0.7) & (zz <= lim.updraft_max_km)
    cls[weak.any(axis=0) & (peak >= lim.updraft_dbz) & (cls == CONVECTION)] = UPDRAFT
    lone = (cls == UPDRAFT) & (_share(cls == UPDRAFT, "symmetric") <= 0.15)
    if lone.any():
        cls = np.where(lone, _middle(cls, 1), cls)
    return cls


def classify_volume(
    df: DataFrame,
    heights_km: list[float],
    shape: tuple[int, int],
    melting_km: float | str,
    limits: EchoLimits = EchoLimits(),
    tile: int = TILE,
) -> DataFrame:
    """(frame_id, y, x, sl3d) from rows (frame_id, y, x, z, dbz[, melting column]).

    Cells closer to the grid edge than the box are 0.  Rows that are missing count as
    levels without echo; boxes are mirrored at the edge of the grid only.
    """
    melt = F.lit(float(melting_km)) if not isinstance(melting_km, str) else F.max(melting_km)
    km = np.asarray(heights_km, dtype=float)
    nz = len(km)
    packed = df.groupBy("frame_id", "y", "x").agg(
        F.map_from_entries(F.collect_list(F.struct("z", F.col("dbz").cast("double")))).alias("_m"), melt.alias("melt")
    )
    packed = packed.select(
        "frame_id", "y", "x", "melt",
        F.transform(
            F.sequence(F.lit(0), F.lit(nz - 1)), lambda z: F.coalesce(F.element_at("_m", z), F.lit(float("nan")))
        ).alias("profile"),
    )
    schema = T.StructType(
        [*packed.schema.fields[:3], T.StructField("sl3d", T.IntegerType())]
    )
    margin = limits.box_px
    ny, nx = shape

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Patch(pdf, tile_box(pdf, tile, margin + 4, shape))
        column = np.stack(pdf["profile"].to_numpy()).astype(float)
        v = np.stack([p.grid(column[:, k]) for k in range(nz)])
        cls = classify_columns(v, km, p.grid(pdf["melt"].to_numpy(float), 0.0), limits)
        return pdf[["frame_id", "y", "x"]].assign(sl3d=p.take(cls).astype(np.int32))

    inner = F.col("y").between(margin, ny - 1 - margin) & F.col("x").between(margin, nx - 1 - margin)
    out = tile_apply(packed, kernel, schema, tile, halo=margin + 4)
    return out.withColumn("sl3d", F.when(inner, F.col("sl3d")).otherwise(0))
