"""Gaussian smoothing in tiles against the sum over the whole mirrored or periodic field."""

from __future__ import annotations

import math

import numpy as np
import pytest

from driftfield.operators.image import smooth_gaussian
from driftfield.operators.tiles import Wrap


def plain(v, sigma, periodic):
    """Weighted sum over every offset, written out per cell."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    w = [x / sum(w) for x in w]

    def at(i, n, turns):
        if turns:
            return i % n
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i

    ny, nx = v.shape
    rows = np.array([[sum(w[d + r] * v[at(y + d, ny, periodic[0]), x] for d in range(-r, r + 1)) for x in range(nx)] for y in range(ny)])
    return np.array([[sum(w[d + r] * rows[y, at(x + d, nx, periodic[1])] for d in range(-r, r + 1)) for x in range(nx)] for y in range(ny)])


def smoothed(spark, v, drop, sigma, **kw):
    rows = [(1, y, x, float(v[y, x])) for y in range(v.shape[0]) for x in range(v.shape[1]) if (y, x) not in drop]
    df = spark.createDataFrame(rows, "frame_id long, y int, x int, value double")
    out = smooth_gaussian(df, "value", sigma, v.shape, **kw).collect()
    assert len(out) == len(rows)
    return {(r.y, r.x): r.smooth for r in out}


@pytest.mark.parametrize("periodic", [(False, False), (True, False), (True, True)])
@pytest.mark.parametrize("tile, sigma", [(64, 1.0), (4, 1.0), (5, 2.0)])
def test_tiles_against_the_whole_field(spark, periodic, tile, sigma):
    v = np.random.default_rng(1).random((11, 13))
    drop = {(0, 0), (3, 4), (10, 12)}
    for y, x in drop:
        v[y, x] = 0.0
    want = plain(v, sigma, periodic)
    got = smoothed(spark, v, drop, sigma, tile=tile, wrap=Wrap(v.shape, *periodic))
    for (y, x), s in got.items():
        assert s == pytest.approx(want[y, x], rel=1e-9)


def test_missing_values_are_zero_and_an_empty_table_is_empty(spark):
    rows = [(1, 0, 0, None), (1, 0, 1, float("nan")), (1, 1, 0, 2.0)]
    df = spark.createDataFrame(rows, "frame_id long, y int, x int, value double")
    got = {(r.y, r.x): r.smooth for r in smooth_gaussian(df, "value", 1.0, (3, 3)).collect()}
    assert got[0, 0] == pytest.approx(plain(np.array([[0, 0, 0], [2.0, 0, 0], [0, 0, 0]]), 1.0, (False, False))[0, 0])
    assert smooth_gaussian(df.limit(0), "value", 1.0, (3, 3)).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        smooth_gaussian(df, "value", 0.0, (3, 3))
