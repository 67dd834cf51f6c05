"""Marker-controlled watershed on the mask above a contour level, flooded tile by tile.

A flood takes the highest pixel that touches it first.  When it is a pixel's turn depends on the
way the flood came: the lowest pass on the way decides first, then the lowest one after that
pass, and so on.  These passes, each with the number of steps on its level, are the pixel's
``order``; going on to a next pixel drops the passes that are not lower than it and adds it.
Orders only fall while tiles exchange their edges, so tiles are flooded again until none changes,
and a region of any size is never gathered.  Labels then follow in the sequence of the orders:
a pixel takes the label of the pixels flooded before it, and is a line where these have two.

Equal orders are settled by place (smaller row, then column), so nothing depends on visiting
order.  A pixel that only a line leads to stays without a label.  A positive compactness makes
the sequence depend on the label itself; then every region is flooded in one task, and the
largest region is the bound on that task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.operators import image, label
from driftfield.operators.ranking import bucketed_row_number
from driftfield.operators.tiles import Wrap, tile_apply
from driftfield.workspace import Workspace


def flood(value: np.ndarray, marker: np.ndarray, mask: np.ndarray, compactness: float, lines: bool) -> np.ndarray:
    """Flood from markers in order of rising ``-value``; meeting floods leave a 0 line."""
    h, w = value.shape
    lab = np.where(mask, marker, 0)
    done = lab > 0
    heap: list[tuple] = []
    age = 0
    for y, x in zip(*np.nonzero(lab)):
        heap.append((-value[y, x], age, int(y), int(x), int(y), int(x)))
        age += 1
    heapq.heapify(heap)
    while heap:
        _, _, y, x, sy, sx = heapq.heappop(heap)
        near = [(y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)]
        near = [(a, b) for a, b in near if 0 <= a < h and 0 <= b < w and mask[a, b]]
        own = lab[y, x]
        if lines or compactness:
            if done[y, x] and (y, x) != (sy, sx):
                continue
            if lines and (y, x) != (sy, sx):
                met = {lab[a, b] for a, b in near if done[a, b] and lab[a, b] > 0}
                done[y, x] = True
                if len(met) > 1:
                    lab[y, x] = 0
                    continue
                own = lab[sy, sx]
                lab[y, x] = own
            elif (y, x) != (sy, sx):
                done[y, x] = True
                own = lab[y, x] = lab[sy, sx]
        for a, b in near:
            if done[a, b] or lab[a, b] > 0:
                continue
            cost = -value[a, b]
            if compactness:
                cost += compactness * np.hypot(a - sy, b - sx)
            if not (lines or compactness):
                lab[a, b] = own
            age += 1
            heapq.heappush(heap, (cost, age, a, b, sy, sx))
    return lab


STATE = "frame_id long, y int, x int, value double, marker int, key binary, object_id int, changed boolean"


def passed(order: tuple, depth: float) -> tuple:
    """The order of a pixel at ``depth`` (minus its value) that is reached from one with ``order``: (depth, steps) pairs."""
    k = len(order)
    while k and order[k - 2] < depth:
        k -= 2
    if k and order[k - 2] == depth:
        return (*order[: k - 1], order[k - 1] + 1.0)
    return (*order[:k], depth, 0.0)


class _Tile:
    """A tile's masked pixels and the ring around them, by place."""

    def __init__(self, pdf: pd.DataFrame, tile: int, wrap: Wrap | None):
        self.at = list(zip(pdf["y"].tolist(), pdf["x"].tolist(), strict=True))
        own = (pdf["y"] // tile == pdf["_ty"]) & (pdf["x"] // tile == pdf["_tx"])
        if wrap is not None:
            own &= wrap.inside(pdf["y"], pdf["x"])
        self.own = dict(zip(self.at, own.tolist(), strict=True))
        self.depth = dict(zip(self.at, (-pdf["value"]).tolist(), strict=True))
        self.marker = {p: m for p, m in zip(self.at, pdf["marker"].tolist(), strict=True) if m > 0}
        self.order = {
            p: tuple(np.frombuffer(k, "<f8").tolist()) for p, k in zip(self.at, pdf["key"], strict=True) if k is not None
        }

    def near(self, p: tuple[int, int]) -> list[tuple[int, int]]:
        y, x = p
        return [q for q in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)) if q in self.depth]

    def flooded(self) -> dict[tuple[int, int], tuple]:
        """Orders of all pixels, those of the ring being given."""
        order = {p: (self.depth[p], 0.0) for p in self.marker}
        order |= {p: k for p, k in self.order.items() if not self.own[p]}
        heap = [(k, p) for p, k in order.items()]
        heapq.heapify(heap)
        while heap:
            key, p = heapq.heappop(heap)
            if key > order[p]:
                continue
            for q in self.near(p):
                if self.own[q] and q not in self.marker:
                    found = passed(key, self.depth[q])
                    if q not in order or found < order[q]:
                        order[q] = found
                        heapq.heappush(heap, (found, q))
        return order

    def labelled(self, known: dict[tuple[int, int], int], lines: bool) -> dict[tuple[int, int], int]:
        """Labels of all pixels that have an order, those of the ring being given."""
        labels = {p: n for p, n in known.items() if not self.own[p]}
        for p in sorted((p for p in self.order if self.own[p]), key=lambda p: (self.order[p], p)):
            if p in self.marker:
                labels[p] = self.marker[p]
                continue
            turn = (self.order[p], p)
            before = [(self.order[q], q) for q in self.near(p) if labels.get(q, 0) > 0 and (self.order[q], q) < turn]
            met = {labels[q] for _, q in before}
            labels[p] = 0 if not met or (lines and len(met) > 1) else labels[min(before)[1]]
        return labels


def flood_tiles(
    marked: DataFrame, ws: Workspace, lines: bool, shape: tuple[int, int], tile: int, wrap: Wrap | None = None
) -> DataFrame:
    """(frame_id, y, x, object_id) of masked pixels (frame_id, y, x, value, marker; marker 0 where there is none).

    Where the grid is one tile, each pass is the last.
    """
    columns = [c.split()[0] for c in STATE.split(", ")]

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _Tile(pdf, tile, wrap).flooded()
        keys = [np.array(found[p], "<f8").tobytes() if p in found else None for p in zip(pdf["y"], pdf["x"], strict=True)]
        changed = [k != (None if old is None else bytes(old)) for k, old in zip(keys, pdf["key"], strict=True)]
        return pdf[columns].assign(key=keys, changed=changed)

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = _Tile(pdf, tile, wrap)
        found = pixels.labelled(dict(zip(pixels.at, pdf["object_id"].tolist(), strict=True)), lines)
        ids = np.array([found.get(p, 0) for p in pixels.at], np.int32)
        return pdf[columns].assign(object_id=ids, changed=ids != pdf["object_id"].to_numpy())

    state = marked.select(
        "frame_id", "y", "x", "value", "marker", F.lit(None).cast("binary").alias("key"),
        F.lit(0).alias("object_id"), F.lit(True).alias("changed"),
    )
    for kernel, stage in ((spread, "flooded"), (name, "objects")):
        while True:
            state = ws.write(tile_apply(state, kernel, STATE, tile, halo=1, wrap=wrap), stage)
            if (wrap is None and max(shape) <= tile) or state.where("changed").isEmpty():
                break
    return state.where("object_id > 0").select("frame_id", "y", "x", "object_id")


def watershed(
    df: DataFrame,
    ws: Workspace,
    value: str,
    min_distance: int,
    border: int,
    peak_min: float,
    contour: float,
    shape: tuple[int, int],
    compactness: float = 0.0,
    lines: bool = True,
    tile: int = image.TILE,
    wrap: Wrap | None = None,
) -> DataFrame:
    """Objects (frame_id, y, x, object_id) around local maxima; ids rank the peaks by height.

    Peaks within ``min_distance`` of each other (a plateau) count once.
    """
    px = df.select("frame_id", "y", "x", F.col(value).cast("double").alias("value"))
    peaks = image.local_peaks(px, "value", min_distance, peak_min, border, shape, tile, wrap).where("is_peak").drop("is_peak")
    peaks = image.spaced_peaks(peaks, ws, "value", min_distance, tile, wrap)
    step = F.floor(F.col("value"))
    markers = bucketed_row_number(
        peaks, ["frame_id"], {"_step": -step}, [F.desc("value"), F.col("y"), F.col("x")], "marker"
    ).select("frame_id", "y", "x", F.col("marker").cast("int").alias("marker"))
    inside = px.where(F.col("value") > contour)
    if not compactness:
        marked = inside.join(markers, ["frame_id", "y", "x"], "left").withColumn("marker", F.coalesce("marker", F.lit(0)))
        return flood_tiles(ws.write(marked, "marked"), ws, lines, shape, tile, wrap)
    inside = label.label_regions(inside, ws, shape=shape, tile=tile)
    marked = inside.join(markers, ["frame_id", "y", "x"], "left").withColumn("marker", F.coalesce("marker", F.lit(0)))
    seeded = marked.groupBy("frame_id", "region").agg(F.max("marker").alias("_m")).where("_m > 0")
    rows = marked.join(seeded.select("frame_id", "region"), ["frame_id", "region"], "left_semi")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = image.Patch(pdf)
        v = p.grid(pdf["value"].to_numpy(float), 0.0)
        mask = p.grid(True, False, bool)
        lab = flood(v, p.grid(pdf["marker"].to_numpy(np.int64), 0, np.int64), mask, compactness, lines)
        out = pdf[["frame_id", "y", "x"]].assign(object_id=p.take(lab).astype(np.int32))
        return out[out["object_id"] > 0]

    return rows.groupBy("frame_id", "region").applyInPandas(kernel, "frame_id long, y int, x int, object_id int")
