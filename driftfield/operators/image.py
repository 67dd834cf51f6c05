"""Neighbourhood operators on pixels, run in halo tiles (see ``tiles``).

Each operator takes long pixel tables (frame_id, y, x, value...) and gives long
tables back; absent pixels are missing data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.operators import distance
from driftfield.operators.tiles import TILE, Wrap, tile_apply, tile_box
from driftfield.workspace import Workspace

REACH = 32


class Patch:
    """Dense view of a tile's pixels: their bounding box, or the given box (y0, x0, end y, end x)."""

    def __init__(self, pdf: pd.DataFrame, box: tuple[int, int, int, int] | None = None):
        self.y = pdf["y"].to_numpy(np.int64)
        self.x = pdf["x"].to_numpy(np.int64)
        y0, x0, y1, x1 = box or (self.y.min(), self.x.min(), self.y.max() + 1, self.x.max() + 1)
        self.y0, self.x0 = y0, x0
        self.yy, self.xx = self.y - y0, self.x - x0
        self.shape = (y1 - y0, x1 - x0)

    def grid(self, values, fill=np.nan, dtype=float) -> np.ndarray:
        out = np.full(self.shape, fill, dtype=dtype)
        out[self.yy, self.xx] = values
        return out

    def take(self, a: np.ndarray) -> np.ndarray:
        return a[self.yy, self.xx]


def _schema(df: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])


def disk_spans(ry: float, rx: float) -> list[tuple[int, int]]:
    """(row offset, half width) of the rows of a disk of ry x rx pixels."""
    limit = ry * rx
    spans = []
    for dy in range(-int(ry), int(ry) + 1):
        if dy * dy <= limit:
            spans.append((dy, min(int(rx), int(np.sqrt(limit - dy * dy) + 1e-9))))
    return spans


def disk_sum(a: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Sum over the disk around each cell, one running row sum per disk row."""
    h, w = a.shape
    run = np.concatenate([np.zeros((h, 1)), np.cumsum(a, axis=1)], axis=1)
    cols = np.arange(w)
    out = np.zeros(a.shape)
    for dy, half in spans:
        if abs(dy) >= h:
            continue
        rows = run[:, np.clip(cols + half + 1, 0, w)] - run[:, np.clip(cols - half, 0, w)]
        lo, hi = max(0, -dy), min(h, h - dy)
        out[lo:hi] += rows[lo + dy:hi + dy]
    return out


def disk_any(a: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    return disk_sum(a.astype(float), spans) > 0.5


def disk_min(a: np.ndarray, spans: list[tuple[int, int]], fill) -> np.ndarray:
    h, w = a.shape
    ry = max(abs(s[0]) for s in spans)
    rx = max(s[1] for s in spans)
    padded = np.pad(a, ((ry, ry), (rx, rx)), constant_values=fill)
    out = np.full(a.shape, fill, dtype=a.dtype)
    for dy, half in spans:
        for dx in range(-half, half + 1):
            np.minimum(out, padded[ry + dy:ry + dy + h, rx + dx:rx + dx + w], out=out)
    return out


# -- smoothing and filling ------------------------------------------------------


def box_weights(size: int) -> np.ndarray:
    """Box of ``size`` pixels; an even box is one wider with half-weight ends."""
    if size % 2:
        return np.ones(size)
    w = np.ones(size + 1)
    w[0] = w[-1] = 0.5
    return w


def smooth_box(
    df: DataFrame, value: str, size: int, shape: tuple[int, int], out: str = "smooth", tile: int = TILE,
    wrap: Wrap | None = None,
) -> DataFrame:
    """Mean over a box, missing neighbours left out, the grid edge repeated outward (or going on, where it is periodic).

    Pixels that are missing themselves stay missing.
    """
    weights = box_weights(size)
    r = len(weights) // 2
    ny, nx = shape
    open_y, open_x = (True, True) if wrap is None else (not wrap.y, not wrap.x)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Patch(pdf)
        v = p.grid(pdf[value].to_numpy(float))
        # repeat the outermost grid rows and columns where this tile touches them
        pads = [
            (r if open_y and p.y0 == 0 else 0, r if open_y and p.y0 + p.shape[0] == ny else 0),
            (r if open_x and p.x0 == 0 else 0, r if open_x and p.x0 + p.shape[1] == nx else 0),
        ]
        v = np.pad(v, pads, mode="edge")
        good = np.isfinite(v)
        total, count = np.where(good, v, 0.0), good.astype(float)
        for axis in (0, 1):
            total = np.apply_along_axis(np.convolve, axis, total, weights, "full")
            count = np.apply_along_axis(np.convolve, axis, count, weights, "full")
        cut_y, cut_x = r + pads[0][0], r + pads[1][0]
        cell = (p.yy + cut_y, p.xx + cut_x)
        own = np.isfinite(pdf[value].to_numpy(float))
        mean = np.where(own, total[cell] / np.where(count[cell] > 0, count[cell], np.nan), np.nan)
        return pdf[cols].assign(**{out: mean})

    cols = df.columns
    return tile_apply(df, kernel, _schema(df, (out, T.DoubleType())), tile, halo=r, wrap=wrap).withColumn(
        out, F.nanvl(out, F.lit(None))
    )


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Normalised weights out to ``truncate`` standard deviations, rounded to whole pixels."""
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def smooth_gaussian(
    df: DataFrame, value: str, sigma: float, shape: tuple[int, int], out: str = "smooth", truncate: float = 4.0,
    tile: int = TILE, wrap: Wrap | None = None,
) -> DataFrame:
    """Gaussian mean of a field, along rows and then along columns.

    Missing values, and cells of the grid without a row, count as zero; every row gets a result.  Beyond an open edge
    the field is its mirror image, the outermost cell repeated; beyond a periodic one it goes on at the opposite edge.
    """
    if not sigma > 0:
        raise ValueError("sigma must be above 0")
    weights = gaussian_weights(sigma, truncate)
    r = len(weights) // 2
    ny, nx = shape
    periodic = (False, False) if wrap is None else (wrap.y, wrap.x)
    cols = df.columns

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        box = tile_box(pdf, tile, r, shape, wrap)
        p = Patch(pdf, box)
        v = np.nan_to_num(p.grid(pdf[value].to_numpy(float), 0.0), nan=0.0, posinf=np.inf, neginf=-np.inf)
        for axis, n in ((0, ny), (1, nx)):
            mirrored = [
                r if not periodic[axis] and box[axis] == 0 else 0,
                r if not periodic[axis] and box[axis + 2] == n else 0,
            ]
            pads = [(0, 0), (0, 0)]
            pads[axis] = tuple(mirrored)
            v = np.apply_along_axis(np.convolve, axis, np.pad(v, pads, mode="symmetric"), weights, "full")
            first = r + mirrored[0]
            v = np.take(v, np.arange(first, first + p.shape[axis]), axis=axis)
        return pdf[cols].assign(**{out: p.take(v)})

    return tile_apply(df, kernel, _schema(df, (out, T.DoubleType())), tile, halo=r, wrap=wrap)


def fill_median(
    df: DataFrame, value: str, size: int, tile: int = TILE, shape: tuple[int, int] | None = None,
    wrap: Wrap | None = None,
) -> DataFrame:
    """Replace missing values by the median of their box.

    Cells outside the grid count as zero and missing ones as the largest, so a
    mostly missing box gives no median.  ``shape`` is the grid's size; cells inside
    it that have no row are missing too.  Without it the rows' extent is the grid.
    """
    r = size // 2
    cols = df.columns

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Patch(pdf)
        v = np.pad(p.grid(pdf[value].to_numpy(float)), r, constant_values=0.0 if shape is None else np.nan)
        ends = [] if shape is None else [(a, f) for a, f in ((0, p.y0), (1, p.x0)) if wrap is None or not (wrap.y, wrap.x)[a]]
        for axis, first in ends:
            at = np.arange(first - r, first - r + v.shape[axis])
            np.moveaxis(v, axis, 0)[(at < 0) | (at >= shape[axis])] = 0.0
        own = pdf[value].to_numpy(float)
        gaps = np.nonzero(~np.isfinite(own))[0]
        if len(gaps):
            box = np.lib.stride_tricks.sliding_window_view(v, (size, size))
            flat = np.sort(box[p.yy[gaps], p.xx[gaps]].reshape(len(gaps), -1), axis=1)
            own = own.copy()
            own[gaps] = flat[:, flat.shape[1] // 2]  # missing values sort last
        return pdf[cols].assign(**{value: own})

    return tile_apply(df, kernel, df.schema, tile, halo=r, wrap=wrap).withColumn(value, F.nanvl(value, F.lit(None)))


# -- convective classification ------------------------------------------------------


def background_mean(
    df: DataFrame, dbz: str, radius_m: float, dx_m: float, dy_m: float, out: str = "background", tile: int = TILE,
    wrap: Wrap | None = None,
) -> DataFrame:
    """Mean reflectivity (in linear units) of the valid pixels within a radius."""
    ry, rx = radius_m / dy_m, radius_m / dx_m
    spans = disk_spans(ry, rx)
    cols = df.columns

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Patch(pdf)
        v = p.grid(pdf[dbz].to_numpy(float))
        good = np.isfinite(v)
        z = np.where(good, 10.0 ** (np.where(good, v, 0.0) / 10.0), 0.0)
        total, n = disk_sum(z, spans), disk_sum(good.astype(float), spans)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(good & (n > 0.5), 10.0 * np.log10(total / np.round(n)), np.nan)
        return pdf[cols].assign(**{out: p.take(mean)})

    halo = int(max(ry, rx)) + 1
    return tile_apply(df, kernel, _schema(df, (out, T.DoubleType())), tile, halo, wrap=wrap).withColumn(
        out, F.nanvl(out, F.lit(None))
    )


def box_mean_linear(
    df: DataFrame, dbz: str, size: int, out: str, tile: int = TILE, wrap: Wrap | None = None
) -> DataFrame:
    """Moving box mean of reflectivity in linear units over valid pixels."""
    r = size // 2
    spans = [(dy, r) for dy in range(-r, r + 1)]
    cols = df.columns

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Patch(pdf)
        v = p.grid(pdf[dbz].to_numpy(float))
        good = np.isfinite(v)
        z = np.where(good, 10.0 ** (np.where(good, v, 0.0) / 10.0), 0.0)
        total, n = disk_sum(z, spans), disk_sum(good.astype(float), spans)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(good, 10.0 * np.log10(total / np.round(n)), np.nan)
        return pdf[cols].assign(**{out: p.take(mean)})

    return tile_apply(df, kernel, _schema(df, (out, T.DoubleType())), tile, halo=r + 1, wrap=wrap)


def dilate_cores(
    df: DataFrame, core: str, radius_km: str, max_radius_km: float, dx_m: float, dy_m: float,
    out: str = "dilated", tile: int = TILE, wrap: Wrap | None = None,
) -> DataFrame:
    """1 where a core pixel lies within that core's own radius, else 0."""
    cols = df.columns

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Patch(pdf)
        seed = pdf[core].to_numpy() == 1
        radius = np.nan_to_num(pdf[radius_km].to_numpy(float))
        hit = p.grid(seed, False, bool)
        for r in np.unique(radius[seed]):
            if r > 0:
                source = p.grid(seed & (radius == r), False, bool)
                hit |= disk_any(source, disk_spans(r * 1000 / dy_m, r * 1000 / dx_m))
        return pdf[cols].assign(**{out: p.take(hit).astype(np.int32)})

    halo = int(max_radius_km * 1000 / min(dx_m, dy_m)) + 1
    return tile_apply(df, kernel, _schema(df, (out, T.IntegerType())), tile, halo, wrap=wrap)


def expand_cores(
    df: DataFrame, label: str, radii_km: Sequence[float], dx_m: float, dy_m: float,
    out: str = "cell", tile: int = TILE, nearest: bool = False, wrap: Wrap | None = None,
) -> DataFrame:
    """Grow numbered cores outward radius by radius; the smallest number wins a contested pixel.

    ``df`` holds every grid pixel with label 0 outside cores.  With ``nearest``
    every pixel within the largest radius goes to its closest core instead (an exact
    distance transform, whose time does not depend on the radius).
    """
    cols = df.columns
    none = np.iinfo(np.int64).max

    def closest(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Patch(pdf)
        core = p.grid(pdf[label].to_numpy(np.int64), 0, np.int64)
        cell = distance.nearest_number(core, dy_m, dx_m, max(radii_km) * 1000)
        return pdf[cols].assign(**{out: p.take(cell).astype(np.int32)})

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Patch(pdf)
        core = p.grid(pdf[label].to_numpy(np.int64), 0, np.int64)
        source = np.where(core > 0, core, none)
        cell = core.copy()
        for r in radii_km:
            near = disk_min(source, disk_spans(r * 1000 / dy_m + 1e-9, r * 1000 / dx_m + 1e-9), none)
            claim = (cell == 0) & (near < none)
            cell[claim] = near[claim]
        return pdf[cols].assign(**{out: p.take(cell).astype(np.int32)})

    halo = int(max(radii_km) * 1000 / min(dx_m, dy_m)) + 1
    return tile_apply(df, closest if nearest else kernel, _schema(df, (out, T.IntegerType())), tile, halo, wrap=wrap)


# -- growth from seeds ------------------------------------------------------------


def _neighbours(lab: np.ndarray, cells: tuple, offsets) -> np.ndarray:
    padded = np.pad(lab, 1)
    return np.stack([padded[cells[0] + 1 + dy, cells[1] + 1 + dx] for dy, dx in offsets], axis=1)


SIDES = [(-1, 0), (0, -1), (0, 1), (1, 0)]
RING = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def most_common(near: np.ndarray) -> np.ndarray:
    """Most frequent positive label per row, the smallest on ties, 0 if there is none."""
    count = (near[:, :, None] == near[:, None, :]).sum(axis=2)
    count[near <= 0] = 0
    best = count.max(axis=1)
    pick = np.where(count == best[:, None], near, np.iinfo(np.int64).max).min(axis=1)
    return np.where(best > 0, pick, 0)


def smallest(near: np.ndarray) -> np.ndarray:
    pick = np.where(near > 0, near, np.iinfo(np.int64).max).min(axis=1)
    return np.where(pick < np.iinfo(np.int64).max, pick, 0)


def grow_labels(
    df: DataFrame, ws: Workspace, label: str, open_: str, rule: str, tile: int = TILE, reach: int = REACH,
    wrap: Wrap | None = None,
) -> DataFrame:
    """Spread labels ring by ring into open pixels until nothing changes.

    Every ring only looks at labels of earlier rings.  ``rule`` is ``"vote"``
    (8 neighbours, most frequent label, smallest on ties) or ``"first"`` (4
    neighbours, smallest label).  One pass of tiles grows ``reach`` rings, which
    a halo of the same width keeps exact; passes repeat while any tile was
    still growing in its last ring.
    """
    offsets, choose = (RING, most_common) if rule == "vote" else (SIDES, smallest)
    cols = df.columns
    state = df.withColumn("_late", F.lit(False))
    schema = state.schema
    dtype = {f.name: f.dataType for f in df.schema.fields}[label]
    as_type = np.int32 if isinstance(dtype, T.IntegerType) else np.int64

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Patch(pdf)
        lab = p.grid(pdf[label].to_numpy(np.int64), 0, np.int64)
        free = p.grid(pdf[open_].to_numpy(bool), False, bool)
        late = np.zeros(p.shape, dtype=bool)
        for ring in range(reach):
            cells = np.nonzero(free & (lab == 0))
            if not len(cells[0]):
                break
            got = choose(_neighbours(lab, cells, offsets))
            if not got.any():
                break
            lab[cells] = got
            if ring == reach - 1:
                late[cells] = got > 0
        return pdf[cols].assign(**{label: p.take(lab).astype(as_type)}, _late=p.take(late))

    while True:
        grown = tile_apply(state.select(*cols), kernel, schema, tile, halo=reach, wrap=wrap)
        state = ws.write(grown, "grown")
        if state.where("_late").isEmpty():
            return state.select(*cols)


# -- peaks and watershed --------------------------------------------------------------


def local_peaks(
    df: DataFrame, value: str, min_distance: int, threshold: float, border: int, shape: tuple[int, int],
    tile: int = TILE, wrap: Wrap | None = None,
) -> DataFrame:
    """Pixels that are the maximum of their (2d+1)^2 box and exceed the threshold.

    Adds ``is_peak``; peaks closer than ``border`` to an edge of the grid (not to a periodic one) are dropped.
    """
    d = min_distance
    ny, nx = shape
    cols = df.columns

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Patch(pdf)
        v = np.nan_to_num(p.grid(pdf[value].to_numpy(float)), nan=-np.inf)
        box = np.lib.stride_tricks.sliding_window_view(np.pad(v, d, constant_values=-np.inf), (2 * d + 1, 2 * d + 1))
        peak = (v == box.max(axis=(2, 3))) & (v > threshold)
        return pdf[cols].assign(is_peak=p.take(peak))

    periodic = () if wrap is None else dict(wrap.axes())
    inside = F.lit(True)
    for axis, n in (("y", ny), ("x", nx)):
        if axis not in periodic:
            inside = inside & F.col(axis).between(border, n - 1 - border)
    out = tile_apply(df, kernel, _schema(df, ("is_peak", T.BooleanType())), tile, halo=d, wrap=wrap)
    return out.withColumn("is_peak", F.col("is_peak") & inside)


def spaced_peaks(
    peaks: DataFrame, ws: Workspace, value: str, min_distance: int, tile: int = TILE, wrap: Wrap | None = None
) -> DataFrame:
    """Peaks without those within ``min_distance`` (rows and columns) of a kept one, in order of height, then of place.

    Whether a peak stays depends on the higher ones around it, theirs on others; tiles settle
    what they can see and go on until no peak is open.
    """
    d = min_distance
    halo = 8 * d
    cols = peaks.columns
    open_, kept, gone = 0, 1, 2
    state = peaks.withColumn("_state", F.lit(open_))
    schema = state.schema

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["_ty"].iat[0]) * tile, int(pdf["_tx"].iat[0]) * tile
        at = list(zip(pdf["y"].tolist(), pdf["x"].tolist(), strict=True))
        told = dict(zip(at, pdf["_state"].tolist(), strict=True))
        turn = {p: (-v, p) for p, v in zip(at, pdf[value].tolist(), strict=True)}
        for y, x in sorted((p for p in at if told[p] == open_), key=turn.get):
            if not (ty - halo + d <= y < ty + tile + halo - d and tx - halo + d <= x < tx + tile + halo - d):
                continue  # what is around it is not all here
            around = [(y + i, x + j) for i in range(-d, d + 1) for j in range(-d, d + 1)]
            before = [told[q] for q in around if q in told and turn[q] < turn[y, x]]
            if kept in before:
                told[y, x] = gone
            elif open_ not in before:
                told[y, x] = kept
        return pdf[[*cols, "_state"]].assign(_state=np.array([told[p] for p in at], np.int32))

    while True:
        state = ws.write(tile_apply(state, kernel, schema, tile, halo=halo, wrap=wrap), "spaced_peaks")
        if state.where(F.col("_state") == open_).isEmpty():
            return state.where(F.col("_state") == kept).select(*cols)
