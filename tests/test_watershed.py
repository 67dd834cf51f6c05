"""Watershed by tiles against the sequential flood, and peaks on plateaus."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftfield.operators import image, watershed
from driftfield.operators.tiles import Wrap

N = 34


def table(spark, v):
    yy, xx = np.mgrid[0 : v.shape[0], 0 : v.shape[1]]
    pdf = pd.DataFrame({"frame_id": 1, "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32"), "v": v.ravel()})
    return spark.createDataFrame(pdf).withColumn("frame_id", F.col("frame_id").cast("long"))


def bumps(seed, count=16):
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[0:N, 0:N]
    at = rng.uniform(0, N, (count, 2))
    return sum(rng.uniform(0.5, 1.5) * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / rng.uniform(5, 40)) for y, x in at)


def ids(out, shape=(N, N)):
    got = np.zeros(shape, int)
    pdf = out.toPandas()
    got[pdf.y, pdf.x] = pdf.object_id
    return got


def plain_peaks(v, d, least):
    """Maxima of their boxes, highest first, none within ``d`` of one taken before."""
    pad = np.pad(v, d, constant_values=-np.inf)
    top = (v == np.lib.stride_tricks.sliding_window_view(pad, (2 * d + 1,) * 2).max(axis=(2, 3))) & (v > least)
    taken = []
    for y, x in sorted(zip(*np.nonzero(top)), key=lambda p: (-v[p], p)):
        if all(max(abs(y - b), abs(x - a)) > d for b, a in taken):
            taken.append((int(y), int(x)))
    return taken


def sequential(v, d, least, contour, lines):
    marker = np.zeros(v.shape, int)
    for k, p in enumerate(plain_peaks(v, d, least)):
        marker[p] = k + 1
    return watershed.flood(v, marker, v > contour, 0.0, lines)


@pytest.mark.parametrize("tile", [64, 9])
def test_objects_equal_the_sequential_flood(spark, ws, tile):
    for seed in (1, 2):
        v = bumps(seed)
        got = ids(watershed.watershed(table(spark, v), ws, "v", 2, 0, 0.6, 0.3, (N, N), lines=False, tile=tile))
        assert (got == sequential(v, 2, 0.6, 0.3, False)).all() and got.max() > 2
        lined = ids(watershed.watershed(table(spark, v), ws, "v", 2, 0, 0.6, 0.3, (N, N), tile=tile))
        assert (lined != sequential(v, 2, 0.6, 0.3, True)).mean() < 0.01


def test_noise_and_a_region_larger_than_a_tile(spark, ws):
    """Every pass matters in noise; the whole mask is one region over many tiles."""
    v = np.random.default_rng(3).random((N, N))
    whole = ids(watershed.watershed(table(spark, v), ws, "v", 3, 0, 0.9, 0.02, (N, N), lines=False, tile=64))
    assert (whole == sequential(v, 3, 0.9, 0.02, False)).all()
    assert (ids(watershed.watershed(table(spark, v), ws, "v", 3, 0, 0.9, 0.02, (N, N), lines=False, tile=7)) == whole).all()
    lined = [ids(watershed.watershed(table(spark, v), ws, "v", 3, 0, 0.9, 0.02, (N, N), tile=t)) for t in (64, 7)]
    assert (lined[0] == lined[1]).all()


def test_levels_do_not_depend_on_tiles(spark, ws):
    """Equal values everywhere: steps on a level and places decide."""
    v = np.round(bumps(5), 1)
    one, two = (ids(watershed.watershed(table(spark, v), ws, "v", 2, 0, 0.6, 0.2, (N, N), tile=t)) for t in (64, 8))
    assert (one == two).all() and one.max() == len(plain_peaks(v, 2, 0.6))


def test_one_peak_per_plateau(spark, ws):
    v = np.zeros((N, N))
    v[3:5, 2:30] = 2.0  # a ridge longer than what a tile sees at once
    v[20:25, 20:25] = 3.0
    v[10, 10] = v[10, 13] = 1.0
    v[12, 30] = 1.5
    for tile in (64, 5):
        px = table(spark, v)
        peaks = image.local_peaks(px, "v", 2, 0.5, 0, (N, N), tile).where("is_peak").drop("is_peak")
        got = image.spaced_peaks(peaks, ws, "v", 2, tile).collect()
        assert sorted((r.y, r.x) for r in got) == sorted(plain_peaks(v, 2, 0.5))
    assert len(peaks.collect()) > 50


def test_flood_across_the_edge(spark, ws):
    v = bumps(2)
    v = np.maximum(v, np.roll(v, (17, 17), (0, 1)))
    both = Wrap((N, N), True, True)
    one = ids(watershed.watershed(table(spark, v), ws, "v", 2, 0, 0.7, 0.4, (N, N), tile=9, wrap=both))
    two = ids(watershed.watershed(table(spark, np.roll(v, (5, 20), (0, 1))), ws, "v", 2, 0, 0.7, 0.4, (N, N), tile=64, wrap=both))
    parts = [{frozenset(zip(*np.nonzero(a == n))) for n in np.unique(a[a > 0])} for a in (np.roll(one, (5, 20), (0, 1)), two)]
    assert parts[0] == parts[1]


def test_no_peaks_no_objects(spark, ws):
    assert watershed.watershed(table(spark, np.zeros((N, N))), ws, "v", 2, 0, 0.5, -1.0, (N, N)).count() == 0
    assert watershed.watershed(table(spark, np.ones((N, N))).limit(0), ws, "v", 2, 0, 0.5, 0.1, (N, N)).count() == 0
