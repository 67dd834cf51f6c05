from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftfield.operators import clouds, echo, image, sl3d, watershed
from driftfield.functions import physics

N = 26


def table(spark, **arrays):
    yy, xx = np.mgrid[0:N, 0:N]
    pdf = pd.DataFrame({"frame_id": 1, "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32")})
    for name, a in arrays.items():
        pdf[name] = np.asarray(a).ravel()
    return spark.createDataFrame(pdf).withColumn("frame_id", F.col("frame_id").cast("long"))


def back(df, col):
    return df.toPandas().sort_values(["y", "x"])[col].to_numpy().reshape(N, N)


@pytest.mark.parametrize("size,tile", [(3, 7), (5, 64), (10, 9)])
def test_box_smoothing(spark, size, tile):
    v = np.random.default_rng(1).random((N, N))
    w = image.box_weights(size)
    r = len(w) // 2
    weights = np.outer(w, w) / w.sum() ** 2
    want = (np.lib.stride_tricks.sliding_window_view(np.pad(v, r, mode="edge"), (2 * r + 1,) * 2) * weights).sum(axis=(2, 3))
    got = back(image.smooth_box(table(spark, v=v), "v", size, (N, N), tile=tile), "smooth")
    assert np.allclose(got, want)


def test_uniform_background_equals_the_value(spark):
    got = back(image.background_mean(table(spark, v=np.full((N, N), 33.0)), "v", 5000, 1000, 1000, tile=8), "background")
    assert np.allclose(got, 33.0)


def test_missing_pixels_have_no_background(spark):
    v = np.full((N, N), 20.0)
    v[3, 4] = np.nan
    got = back(image.background_mean(table(spark, v=v), "v", 3000, 1000, 1000, tile=8), "background")
    assert np.isnan(got[3, 4]) and np.isfinite(np.delete(got.ravel(), 3 * N + 4)).all()


@pytest.mark.parametrize("tile", [6, 64])
def test_dilation_and_expansion_against_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    core = (rng.random((N, N)) < 0.03).astype("int32")
    radius = rng.integers(1, 4, (N, N)).astype(float)
    cy, cx = np.nonzero(core)
    yy, xx = np.mgrid[0:N, 0:N]
    d2 = (yy[..., None] - cy) ** 2 + (xx[..., None] - cx) ** 2
    want = (d2 <= radius[cy, cx] ** 2).any(axis=2).astype(int)
    df = table(spark, core=core, radius=radius)
    assert (back(image.dilate_cores(df, "core", "radius", 3, 1000, 1000, tile=tile), "dilated") == want).all()

    lab = np.zeros((N, N), dtype="int32")
    lab[cy, cx] = np.arange(1, len(cy) + 1)
    cell = lab.copy()
    for r in (1, 2, 3):
        near = np.where(d2 <= r * r, lab[cy, cx], 10**9).min(axis=2)
        claim = (cell == 0) & (near < 10**9)
        cell[claim] = near[claim]
    got = back(image.expand_cores(table(spark, lab=lab), "lab", [1, 2, 3], 1000, 1000, tile=tile), "cell")
    assert (got == cell).all()


def rings(lab, free, vote):
    lab = lab.copy()
    while True:
        new = lab.copy()
        for y in range(N):
            for x in range(N):
                if free[y, x] and lab[y, x] == 0:
                    near = []
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            if (dy, dx) == (0, 0) or (not vote and dy and dx):
                                continue
                            if 0 <= y + dy < N and 0 <= x + dx < N and lab[y + dy, x + dx] > 0:
                                near.append(lab[y + dy, x + dx])
                    if near:
                        ids, n = np.unique(near, return_counts=True)
                        new[y, x] = ids[np.argmax(n)] if vote else ids[0]
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize("rule,tile,reach", [("vote", 6, 3), ("vote", 64, 64), ("first", 5, 2)])
def test_growth_is_the_same_in_any_tiling(spark, ws, rule, tile, reach):
    rng = np.random.default_rng(4)
    lab = np.zeros((N, N), dtype="int32")
    lab[2, 3], lab[20, 20], lab[9, 22] = 1, 2, 3
    free = rng.random((N, N)) < 0.7
    df = table(spark, lab=lab, free=free)
    got = back(image.grow_labels(df, ws, "lab", "free", rule, tile, reach), "lab")
    assert (got == rings(lab, free, rule == "vote")).all()


def test_single_strong_core_is_convective(spark, ws):
    yy, xx = np.mgrid[0:N, 0:N]
    r = np.hypot(yy - 13, xx - 13)
    v = np.where(r < 3, 50.0, np.where(r < 6, 30.0, 20.0))
    out = echo.classify_echo(
        table(spark, dbz=v), ws, "dbz", 1000, 1000, 5000, 5, 40, 45, 10, physics.dilation_steps(), shape=(N, N)
    )
    assert back(out, "echo_class")[13, 13] == echo.CONVECTIVE
    assert back(out, "core")[13, 13] == 1
    assert back(out, "echo_class")[0, 0] == echo.STRATIFORM


def test_dilation_steps():
    edges, radii = physics.dilation_steps(25, 40, 5, 1, 1, 3)
    assert edges == [0.0, 25, 30, 35, 40, 100.0]
    assert radii == [1, 2, 3, 3, 3]
    assert radii == sorted(radii)


def test_cold_clouds_grow_around_cores(spark, ws):
    tb = np.full((N, N), 280.0)
    tb[2:12, 2:12] = 235.0
    tb[4:10, 4:10] = 215.0
    tb[16:24, 14:24] = 236.0
    out = clouds.grow_cold_clouds(
        table(spark, tb=tb, area_km2=np.full((N, N), 100.0)), ws, (225, 241, 261, 261), 800.0, 4, 3, (N, N), tile=9
    )
    number = back(out, "cloudnumber")
    assert (number[2:12, 2:12] == number[2, 2]).all() and number[2, 2] > 0
    assert (number[16:24, 14:24] == number[16, 14]).all() and number[16, 14] not in (0, number[2, 2])
    assert (number[tb > 260] == 0).all()
    assert number[2, 2] == 1  # the larger one
    counts = clouds.cloud_counts(out).toPandas().set_index("feature_id")
    assert counts.loc[1, "ncorepix"] == 36 and counts.loc[1, "ncoldpix"] == 64
    high = clouds.grow_cold_clouds(
        table(spark, tb=tb, area_km2=np.full((N, N), 100.0)), ws, (225, 241, 261, 261), 9000.0, 4, 3, (N, N)
    )
    assert set(np.unique(back(high, "cloudnumber"))) == {0, 1}


def pixel_fold(cloud, rain, skip_last=True):
    out, mask = cloud.copy(), np.zeros(cloud.shape, bool)
    for p in range(1, rain.max() + (0 if skip_last else 1)):
        at = rain == p
        seen = [n for n in np.unique(out[at]) if n > 0]
        if not seen:
            continue
        size = [(out == n).sum() for n in seen]
        top = seen[int(np.argmax(size))]
        for n in seen:
            hit = (out == n) & ~mask
            out[hit], mask[hit] = top, True
        bare = at & (out == 0) & ~mask
        out[bare], mask[bare] = top, True
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_rain_links_clouds_like_the_pixel_by_pixel_pass(spark, ws, seed):
    rng = np.random.default_rng(seed)
    cloud = np.kron(rng.integers(0, 9, (13, 13)), np.ones((2, 2), int))
    rain = np.kron(rng.integers(0, 7, (9, 9)), np.ones((3, 3), int))[:N, :N]
    df = table(
        spark, convcold_cloudnumber=cloud.astype("int32"), cloudnumber=cloud.astype("int32"), pf_number=rain.astype("int32")
    )
    got = clouds.link_rain_clouds(df, ws)
    assert (back(got, "pf_convcold_cloudnumber") == pixel_fold(cloud, rain)).all()


def test_peaks_and_watershed(spark, ws):
    yy, xx = np.mgrid[0:N, 0:N]
    f = np.exp(-((yy - 8) ** 2 + (xx - 8) ** 2) / 18) + 1.2 * np.exp(-((yy - 16) ** 2 + (xx - 17) ** 2) / 18)
    df = table(spark, f=f)
    peaks = image.local_peaks(df, "f", 2, 0.5, 1, (N, N), tile=7).where("is_peak").toPandas()
    assert sorted(zip(peaks.y, peaks.x)) == [(8, 8), (16, 17)]
    out = watershed.watershed(df, ws, "f", 2, 1, 0.5, 0.1, (N, N), lines=False).toPandas()
    at = {(r.y, r.x): r.object_id for r in out.itertuples()}
    assert at[(16, 17)] == 1 and at[(8, 8)] == 2
    assert set(at) == {(int(y), int(x)) for y, x in zip(*np.nonzero(f > 0.1))}
    lined = watershed.watershed(df, ws, "f", 2, 1, 0.5, 0.1, (N, N), lines=True).toPandas()
    assert len(lined) < len(out) and set(lined.object_id) == {1, 2}


def test_volume_classes_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(6)
    v = np.where(rng.random((8, N, N)) < 0.7, 15 + 40 * rng.random((8, N, N)), np.nan)
    z, yy, xx = np.nonzero(np.isfinite(v))
    pdf = pd.DataFrame({"frame_id": 1, "y": yy.astype("int32"), "x": xx.astype("int32"), "z": z.astype("int32"), "dbz": v[z, yy, xx]})
    df = spark.createDataFrame(pdf).withColumn("frame_id", F.col("frame_id").cast("long"))
    heights = [float(k) for k in range(1, 9)]
    lim = sl3d.EchoLimits(box_px=2)
    one = sl3d.classify_volume(df, heights, (N, N), 3.5, lim, tile=64).toPandas().sort_values(["y", "x"])
    many = sl3d.classify_volume(df, heights, (N, N), 3.5, lim, tile=8).toPandas().sort_values(["y", "x"])
    assert (one.sl3d.to_numpy() == many.sl3d.to_numpy()).all()
    assert set(one.sl3d) > {0, 2}


def test_volume_classes_do_not_depend_on_absent_rows(spark):
    rng = np.random.default_rng(7)
    v = np.full((8, N, N), np.nan)
    v[:, 4:14, 5:15] = 15 + 40 * rng.random((8, 10, 10))
    z, yy, xx = np.indices(v.shape).reshape(3, -1)
    pdf = pd.DataFrame({"frame_id": 1, "y": yy.astype("int32"), "x": xx.astype("int32"), "z": z.astype("int32"), "dbz": v.ravel()})
    df = spark.createDataFrame(pdf).withColumn("frame_id", F.col("frame_id").cast("long")).withColumn("dbz", F.nanvl("dbz", F.lit(None)))
    heights, lim = [float(k) for k in range(1, 9)], sl3d.EchoLimits(box_px=2)
    there = {(r.y, r.x): r.sl3d for r in sl3d.classify_volume(df, heights, (N, N), 3.5, lim, tile=64).collect()}
    for tile in (64, 8):
        bare = sl3d.classify_volume(df.where("dbz is not null"), heights, (N, N), 3.5, lim, tile=tile).collect()
        assert len(bare) == 100 and all(there[r.y, r.x] == r.sl3d for r in bare)
