"""Fields on periodic grids and their rolled copies give the same results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftfield.operators import clouds, echo, image, label, motion, precip, shapes
from driftfield.operators.tiles import Wrap

NY, NX = 18, 26
BOTH = Wrap((NY, NX), True, True)
ROLL = (7, 16)


def table(spark, frames=1, **arrays):
    yy, xx = np.mgrid[0:NY, 0:NX]
    parts = []
    for f in range(frames):
        pdf = pd.DataFrame({"frame_id": f + 1, "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32")})
        for name, a in arrays.items():
            pdf[name] = (a[f] if a.ndim == 3 else a).ravel()
        parts.append(pdf)
    return spark.createDataFrame(pd.concat(parts)).withColumn("frame_id", F.col("frame_id").cast("long"))


def grid_of(df, col):
    out = np.full((NY, NX), np.nan)
    pdf = df.toPandas()
    out[pdf.y, pdf.x] = pdf[col].astype(float)
    assert not pdf.duplicated(["y", "x"]).any()
    return out


def partition(labels):
    return {frozenset(zip(*np.nonzero(labels == n))) for n in np.unique(labels[labels > 0])}


def blobs(seed, count=9):
    """A field of smooth bumps on the torus, of different sizes, some across the edges."""
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[0:NY, 0:NX]
    out = np.zeros((NY, NX))
    for k in range(count):
        y, x = (rng.uniform(0, NY), rng.uniform(0, NX)) if k > 2 else ((0.2, 25.7), (9.0, 0.1), (17.6, 12.3))[k]
        dy, dx = np.minimum(abs(yy - y), NY - abs(yy - y)), np.minimum(abs(xx - x), NX - abs(xx - x))
        out = np.maximum(out, rng.uniform(0.6, 1.4) * np.exp(-(dy**2 + dx**2) / rng.uniform(2, 9)))
    return out


@pytest.mark.parametrize("tile", [64, 7])
def test_box_and_disk_kernels(spark, tile):
    v = np.random.default_rng(2).random((NY, NX)) * 40
    rolled = np.roll(v, ROLL, (0, 1))
    for kernel, col in (
        (lambda df: image.smooth_box(df, "v", 5, (NY, NX), tile=tile, wrap=BOTH), "smooth"),
        (lambda df: image.background_mean(df, "v", 3300.0, 1000.0, 1000.0, tile=tile, wrap=BOTH), "background"),
        (lambda df: image.box_mean_linear(df, "v", 3, "m", tile, BOTH), "m"),
    ):
        one, two = grid_of(kernel(table(spark, v=v)), col), grid_of(kernel(table(spark, v=rolled)), col)
        assert np.allclose(np.roll(one, ROLL, (0, 1)), two, atol=1e-9)
    pad = np.pad(v, 2, mode="wrap")
    want = np.lib.stride_tricks.sliding_window_view(pad, (5, 5)).mean(axis=(2, 3))
    assert np.allclose(grid_of(image.smooth_box(table(spark, v=v), "v", 5, (NY, NX), tile=tile, wrap=BOTH), "smooth"), want)


def test_one_periodic_axis_leaves_the_other_open(spark):
    v = np.random.default_rng(3).random((NY, NX))
    pad = np.pad(np.pad(v, ((0, 0), (1, 1)), mode="wrap"), ((1, 1), (0, 0)), mode="edge")
    want = np.lib.stride_tricks.sliding_window_view(pad, (3, 3)).mean(axis=(2, 3))
    got = image.smooth_box(table(spark, v=v), "v", 3, (NY, NX), tile=8, wrap=Wrap((NY, NX), x=True))
    assert np.allclose(grid_of(got, "smooth"), want)


def test_peaks_cores_and_medians(spark):
    v = blobs(5)
    core = label_torus(v > 0.9)
    rolled, core_rolled = np.roll(v, ROLL, (0, 1)), np.roll(core, ROLL, (0, 1))
    for nearest in (False, True):
        one = grid_of(image.expand_cores(table(spark, c=core), "c", [1.0, 2.0, 3.0], 1000.0, 1000.0, tile=9, nearest=nearest, wrap=BOTH), "cell")
        two = grid_of(image.expand_cores(table(spark, c=core_rolled), "c", [1.0, 2.0, 3.0], 1000.0, 1000.0, tile=64, nearest=nearest, wrap=BOTH), "cell")
        assert (np.roll(one, ROLL, (0, 1)) == two).all()
    peaks = [
        grid_of(image.local_peaks(table(spark, v=a), "v", 2, 0.3, 3, (NY, NX), tile=t, wrap=BOTH), "is_peak")
        for a, t in ((v, 7), (rolled, 64))
    ]
    assert (np.roll(peaks[0], ROLL, (0, 1)) == peaks[1]).all() and peaks[0][0, 0] + peaks[0][0, 25] + peaks[0][0].sum() > 0
    holes = np.where(np.random.default_rng(1).random((NY, NX)) < 0.2, np.nan, v)
    filled = [
        grid_of(image.fill_median(table(spark, v=a), "v", 3, 7, (NY, NX), BOTH), "v")
        for a in (holes, np.roll(holes, ROLL, (0, 1)))
    ]
    assert np.allclose(np.roll(filled[0], ROLL, (0, 1)), filled[1], equal_nan=True)


def label_torus(mask):
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if not out[start]:
            n, todo = n + 1, [start]
            while todo:
                y, x = todo.pop()
                if mask[y, x] and not out[y, x]:
                    out[y, x] = n
                    todo += [((y + 1) % NY, x), ((y - 1) % NY, x), (y, (x + 1) % NX), (y, (x - 1) % NX)]
    return out


@pytest.mark.parametrize("tile", [64, 8])
def test_clouds_grow_across_the_edge(spark, ws, tile):
    tb = 270 - 55 * blobs(7)
    area = np.full((NY, NX), 100.0)
    results = []
    for a in (tb, np.roll(tb, ROLL, (0, 1))):
        df = table(spark, tb=a, area_km2=area)
        grown = clouds.grow_cold_clouds(df, ws, (225.0, 241.0, 261.0, 261.0), 250.0, 1, 3, (NY, NX), True, tile=tile, wrap=BOTH)
        results.append([grid_of(grown, c) for c in ("convcold_cloudnumber", "cloudnumber")])
        spread = clouds.detect_and_spread(df, ws, (225.0, 241.0, 261.0, 261.0), 250.0, (NY, NX), tile=tile, wrap=BOTH)
        results[-1] += [grid_of(spread, c) for c in ("convcold_cloudnumber", "cloudnumber")]
    for one, two in zip(*results, strict=True):
        assert partition(np.roll(one, ROLL, (0, 1))) == partition(two)
    across = [p for p in partition(results[0][3]) if {x for _, x in p} >= {0, NX - 1}]
    assert across
    plain = clouds.detect_and_spread(table(spark, tb=tb, area_km2=area), ws, (225.0, 241.0, 261.0, 261.0), 250.0, (NY, NX), tile=tile)
    assert partition(grid_of(plain, "cloudnumber")) != partition(results[0][3])


def rain_table(spark, rain):
    yy, xx = np.mgrid[0:NY, 0:NX]
    df = table(spark, rain=rain)
    return df.withColumns(
        {
            "track_id": F.lit(1).cast("long"), "time_idx": F.lit(0), "area_km2": F.lit(100.0),
            "lat": F.col("y") * 1.0, "lon": F.col("x") * 1.0,
        }
    )


def test_rain_features_keep_their_shape(spark, ws):
    rain = np.round(12 * blobs(11), 3)
    ranges = {"lat_range": (0.0, float(NY)), "lon_range": (0.0, float(NX))}
    found = []
    for a in (rain, np.roll(rain, ROLL, (0, 1))):
        for tile in (64, 7):
            feats, counts = precip.rain_features(
                rain_table(spark, a), ws, 4.0, 8.0, 150.0, 10.0, shape=(NY, NX), tile=tile, wrap=BOTH, ranges=ranges
            )
            pdf = feats.toPandas().sort_values(["pf_npix", "pf_accumrain"]).reset_index(drop=True)
            assert counts.first().pf_npf == len(pdf) > 3
            found.append(pdf)
    same = [c for c in found[0].columns if c.startswith("pf_") and not c.endswith(("lat", "lon")) and "maxrainrate" not in c and c != "pf_rank"]
    for other in found[1:]:
        for c in same:
            assert np.allclose(found[0][c].astype(float), other[c].astype(float), atol=1e-6), (c, found[0][c], other[c])
    for one, two in ((found[0], found[2]),):
        for axis, name, n, by in (("y", "lat", NY, ROLL[0]), ("x", "lon", NX, ROLL[1])):
            assert ((one[f"_c{axis}"] + by) % n == two[f"_c{axis}"]).all()
            gap = (one[f"pf_{name}"] + by - two[f"pf_{name}"]) % n
            assert np.allclose(np.minimum(gap, n - gap), 0, atol=1e-6)
    mask = label_torus(rain > 4)
    assert sorted(found[0].pf_npix) == sorted(n for n in np.bincount(mask.ravel())[1:] if n > 2)


def test_motion_across_the_edge(spark, ws):
    spot = np.zeros((NY, NX))
    spot[5:9, 8:14] = np.arange(24).reshape(4, 6) + 1.0
    pairs = spark.createDataFrame([(1, 2, 1.0)], "frame_id long, next_frame long, dt_h double")
    moves = []
    for by in ((0, 0), (0, 14), (11, 15), (10, 3)):
        frames = np.stack([np.roll(spot, by, (0, 1)), np.roll(spot, (by[0] + 1, by[1] + 2), (0, 1))])
        px = table(spark, 2, value=frames).where("value > 0").withColumn("track_id", F.lit(5).cast("long"))
        row = motion.feature_motion(px, pairs, ws, 3, 10.0, wrap=BOTH).first()
        moves.append((row.move_y, row.move_x, row.movement_speed))
    assert len(set(moves)) == 1 and moves[0][:2] == (1.0, 2.0)


def test_perimeter_and_echo(spark, ws):
    v = 60 * blobs(13)
    masks = []
    for a in (v, np.roll(v, ROLL, (0, 1))):
        out = echo.classify_echo(
            table(spark, dbz=a), ws, "dbz", 1000.0, 1000.0, 3000.0, 10.0, 42.0, 46.0, 20.0,
            ([0.0, 15.0, 30.0, 100.0], [1.0, 2.0, 2.0]), min_core_km2=2.0, shape=(NY, NX), tile=8, wrap=BOTH,
        )
        masks.append([grid_of(out, c) for c in ("conv_mask", "echo_class")])
    assert all((np.roll(x, ROLL, (0, 1)) == y).all() for x, y in zip(*masks, strict=True))
    ring = label.label_regions(table(spark, v=v).where("v > 30").select("frame_id", "y", "x"), ws, wrap=BOTH, tile=8)
    rolled = label.label_regions(table(spark, v=np.roll(v, ROLL, (0, 1))).where("v > 30").select("frame_id", "y", "x"), ws, wrap=BOTH)
    one, two = (sorted(round(r.perimeter, 9) for r in shapes.perimeters(r_, ["frame_id"], 8, BOTH).collect()) for r_ in (ring, rolled))
    assert one == two and len(one) > 2
