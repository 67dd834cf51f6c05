"""Bounded image tiles for neighbourhood kernels.

A frame may be arbitrarily large, so kernels never see a frame: pixels are cut
into square tiles keyed by (frame, tile row, tile column), each extended by a
halo as wide as the kernel reaches.  A group holds at most (tile + 2 halo)^2
pixels whatever the frame holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


@dataclass(frozen=True)
class Wrap:
    """Size of a grid (ny, nx) and the axes whose edges meet."""

    shape: tuple[int, int]
    y: bool = False
    x: bool = False

    def axes(self) -> list[tuple[str, int]]:
        """(axis, size) of every periodic axis."""
        return [(a, n) for a, n, on in (("y", self.shape[0], self.y), ("x", self.shape[1], self.x)) if on]

    def around(self, df: DataFrame, halo: int) -> DataFrame:
        """``df`` with the pixels near a periodic edge once more beyond the opposite one, up to ``halo`` pixels out."""
        for axis, n in self.axes():
            turns = -(-halo // n)
            places = [F.col(axis) + k * n for k in range(-turns, turns + 1)]
            seen = [F.when((v >= -halo) & (v < n + halo), v) for v in places]
            df = df.withColumn(axis, F.explode(F.array_compact(F.array(*seen))))
        return df

    def inside(self, y, x):
        """Which positions lie in the grid, along the periodic axes."""
        kept = True
        for (axis, n), at in ((a, {"y": y, "x": x}[a[0]]) for a in self.axes()):
            kept = kept & (at >= 0) & (at < n)
        return kept


def with_tiles(df: DataFrame, tile: int = TILE, halo: int = 0, wrap: Wrap | None = None) -> DataFrame:
    """Add tile keys ``_ty, _tx``; with a halo each pixel is sent to every tile it touches.

    On a periodic axis the halo of the first and last tile goes on at the opposite edge.
    """
    if halo == 0:
        return df.withColumns(
            {
                "_ty": F.floor(F.col("y") / tile).cast("int"),
                "_tx": F.floor(F.col("x") / tile).cast("int"),
            }
        )

    def reach(col: str):
        lo = F.floor((F.col(col) - halo) / tile).cast("int")
        hi = F.floor((F.col(col) + halo) / tile).cast("int")
        return F.sequence(lo, hi)

    if wrap is not None:
        df = wrap.around(df, halo)
    out = df.withColumn("_ty", F.explode(reach("y"))).withColumn("_tx", F.explode(reach("x")))
    for axis, n in wrap.axes() if wrap is not None else ():
        out = out.where(F.col(f"_t{axis}").between(0, (n - 1) // tile))
    return out


def tile_box(
    pdf: pd.DataFrame, tile: int, halo: int, shape: tuple[int, int], wrap: Wrap | None = None
) -> tuple[int, int, int, int]:
    """(y0, x0, end y, end x) of a group's tile and halo inside the grid (periodic axes go on), whichever rows are present."""
    at = [int(pdf[c].iat[0]) * tile for c in ("_ty", "_tx")]
    periodic = (False, False) if wrap is None else (wrap.y, wrap.x)
    low = [a - halo if on else max(a - halo, 0) for a, on in zip(at, periodic, strict=True)]
    high = [min(a + tile, n) + halo if on else min(a + tile + halo, n) for a, n, on in zip(at, shape, periodic, strict=True)]
    return (*low, *high)


def tile_apply(
    df: DataFrame,
    kernel: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    tile: int = TILE,
    halo: int = 0,
    keys: tuple[str, ...] = ("frame_id",),
    wrap: Wrap | None = None,
) -> DataFrame:
    """Run ``kernel`` per tile and keep only rows inside the tile proper (and the grid, where its edges meet)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = pdf["_ty"].iat[0], pdf["_tx"].iat[0]
        out = kernel(pdf)
        if halo:
            inside = (out["y"] // tile == ty) & (out["x"] // tile == tx)
            if wrap is not None:
                inside &= wrap.inside(out["y"], out["x"])
            out = out[inside]
        return out

    return with_tiles(df, tile, halo, wrap).groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema)
