from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.operators import link, motion, smooth
from tests.conftest import clock


def test_spline_reproduces_parabolas():
    x = np.array([0.0, 1, 2, 4, 5, 7])
    y = 2 - x + 0.5 * x * x
    at = np.array([0.0, 0.5, 3.0, 6.9, 7.0, 8.0])
    got = motion.quadratic_spline(x, y, at)
    assert np.allclose(got[:-1], 2 - at[:-1] + 0.5 * at[:-1] ** 2)
    assert np.isnan(got[-1])
    wild = np.array([0.0, 3, 1, 2, 5, 1])
    assert np.allclose(motion.quadratic_spline(x, wild, x), wild)


def shifted(spark, dy, dx, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for y in range(5):
        for x in range(7):
            v = float(np.round(rng.random() * 10, 3))
            rows += [(1, 1, y + 3, x + 2, v), (1, 2, y + 3 + dy, x + 2 + dx, v)]
    return spark.createDataFrame(rows, "track_id long, frame_id long, y int, x int, value double")


@pytest.mark.parametrize("dy,dx", [(0, 0), (2, 1), (-1, 3)])
def test_known_shift(spark, ws, dy, dx):
    pairs = link.frame_pairs(clock(spark, [1, 2]), 1.5)
    got = motion.feature_motion(shifted(spark, dy, dx), pairs, ws, 3, 2.0).collect()[0]
    assert abs(got.move_y - dy) <= 1 and abs(got.move_x - dx) <= 1
    assert got.movement_distance == pytest.approx(2.0 * np.hypot(got.move_y, got.move_x))


@pytest.mark.parametrize("centred,size", [(True, 1.0), (False, 1.0), (False, 1e5), (False, 1e10)])
def test_line_transform_equals_the_direct_one(spark, ws, centred, size):
    rows = (
        shifted(spark, 1, -2, 3)
        .withColumn("value", F.col("value") * size)
        .withColumn("side", (F.col("frame_id") - 1).cast("int"))
        .withColumn("m", F.lit(1.0))
    )
    products = [("value", "value", "c"), ("m", "value", "s")]
    args = (rows, ["track_id"], ["value", "m"], ["value"], products, ws, centred)
    one = motion.correlate(*args).orderBy("dy", "dx").toPandas()
    lines = motion.correlate(*args, max_box=0).orderBy("dy", "dx").toPandas()
    assert len(one) == len(lines) > 0
    assert np.allclose(one[["dy", "dx", "c", "s"]], lines[["dy", "dx", "c", "s"]], rtol=1e-9)
    assert (one.c == one.c.max()).tolist() == (lines.c == lines.c.max()).tolist()  # ties fall alike


def test_tile_advection_of_a_moving_field(spark, ws):
    rng = np.random.default_rng(1)
    a = rng.random((20, 24)) * 10
    b = np.roll(a, (1, 2), axis=(0, 1))
    rows = [(f, y, x, float(v[y, x])) for f, v in ((1, a), (2, b)) for y in range(20) for x in range(24)]
    px = spark.createDataFrame(rows, "frame_id long, y int, x int, value double")
    pairs = link.frame_pairs(clock(spark, [1, 2]), 1.5)
    got = motion.tile_advection(px, pairs, ws, (20, 24), (1, 2), 1, -1.0, 1.0, 1.0, 3600, 50.0).collect()
    assert {(r.tile_x, r.y, r.x) for r in got} == {(0, 1.0, 2.0), (1, 1.0, 2.0)}
    fast = motion.tile_advection(px, pairs, ws, (20, 24), (1, 1), 1, -1.0, 1.0, 1.0, 3600, 0.0001).collect()
    assert [(r.y, r.x) for r in fast] == [(0.0, 0.0)]


def test_running_median_pads_with_zero(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([5, 9, 7])], "k int, t int, v double")
    got = motion.running_median(df, ["k"], "t", ["v"], 3).orderBy("t").collect()
    assert [r.v for r in got] == [5.0, 7.0, 7.0]


def test_too_few_speeds_become_null(spark):
    rows = [(1, i, 1.0, s, 90.0, 1.0, 0.0) for i, s in enumerate([1.0, 2.0, 99.0, 98.0])]
    rows += [(2, i, 1.0 + i, s, 90.0, 1.0, 0.0) for i, s in enumerate([1.0, 2.0, 99.0, 4.0])]
    df = spark.createDataFrame(rows, "track_id long, time_idx int, " + ", ".join(f"{c} double" for c in motion.MOVES))
    got = {(r.track_id, r.time_idx): r for r in motion.filter_speed(df, 50.0).collect()}
    assert got[(1, 0)].movement_speed is None
    assert got[(2, 2)].movement_speed == pytest.approx(3.0)
    assert got[(2, 2)].movement_distance_x == pytest.approx(3.0)


def test_spike_is_interpolated(spark):
    lon = [0.0, 0.1, 5.0, 0.3, 0.4]
    rows = [(1, i, x, 0.0, float(i)) for i, x in enumerate(lon)]
    df = spark.createDataFrame(rows, "track_id long, time_idx int, meanlon double, meanlat double, v double")
    got = smooth.smooth_tracks(df, 100.0, 1.0, values=("v",)).orderBy("time_idx").collect()
    assert [round(r.meanlon_smooth, 6) for r in got] == [0.0, 0.1, 0.2, 0.3, 0.4]
    assert got[2].v_smooth == 2.0


def test_first_points_are_restored():
    lon = np.array([9.0, 0.0, 0.1, 0.2, 0.3])
    out, _ = smooth.repair(lon, np.zeros(5), 100.0, 1.0)
    assert out[0] == 9.0 and np.allclose(out[1:], lon[1:])
