"""The distance transform against all pairs, and its cost at growing radii."""

from __future__ import annotations

import time

import numpy as np
import pytest

from driftfield.operators import distance


def brute(number, dy, dx, reach):
    out = np.zeros_like(number)
    cores = [(number[y, x], y, x) for y, x in zip(*np.nonzero(number))]
    for y in range(number.shape[0]):
        for x in range(number.shape[1]):
            best = min(((round(((y - b) * dy) ** 2 + ((x - a) * dx) ** 2, 6), n) for n, b, a in cores), default=None)
            if best and best[0] <= reach**2 + 1e-6:
                out[y, x] = best[1]
    return out


@pytest.mark.parametrize(("dy", "dx", "reach"), [(1000.0, 1000.0, 4000.0), (500.0, 500.0, 1250.0), (2000.0, 1000.0, 6000.0), (1500.0, 1000.0, 1e6)])
@pytest.mark.parametrize("share", [0.0, 0.02, 0.3])
def test_closest_number_is_exact(dy, dx, reach, share):
    rng = np.random.default_rng(int(reach) + int(100 * share))
    for shape in ((17, 23), (1, 30), (30, 1), (2, 2)):
        number = np.where(rng.random(shape) < share, rng.integers(1, 6, shape), 0)
        assert (distance.nearest_number(number, dy, dx, reach) == brute(number, dy, dx, reach)).all()


def test_envelope_of_any_costs():
    rng = np.random.default_rng(4)
    cost = rng.integers(-200, 200, (40, 33))
    cost[rng.random(cost.shape) < 0.4] = distance.NONE
    cost[3] = distance.NONE
    for weight in (1, 7):
        at = np.arange(33)
        want = np.minimum((weight * (at[:, None] - at) ** 2)[None] + cost[:, None, :], distance.NONE).min(axis=2)
        assert (distance.envelope(cost, weight) == want).all()


def test_time_does_not_depend_on_the_radius():
    number = np.zeros((356, 356), np.int64)
    spots = np.random.default_rng(1).integers(0, 356, (40, 2))
    number[spots[:, 0], spots[:, 1]] = np.arange(1, 41)
    spent = []
    for reach in (2, 50, 300):
        start = time.perf_counter()
        distance.nearest_number(number, 1.0, 1.0, reach)
        spent.append(time.perf_counter() - start)
    assert max(spent[1:]) < 5 * spent[0] + 0.2, spent
