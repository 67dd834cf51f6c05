"""Exact distance transforms of dense tiles as lower envelopes of parabolas.

``envelope`` gives min over k of ``weight * (x - k)^2 + cost[k]`` along the last axis, for all
rows at once: one pass builds the envelope, one reads it, whatever the distances are.  Two
passes, along columns and along rows, give the two-dimensional transform.  All numbers are
integers, so equal distances are equal; a small number added to the costs breaks such ties.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

#: A cost that no place has.
NONE = np.int64(1) << np.int64(60)


def envelope(cost: np.ndarray, weight: int) -> np.ndarray:
    """The transform of each row of ``cost``; NONE where a row has no cost at all."""
    h, w = cost.shape
    place = np.zeros((h, w), np.int64)  # parabolas on the envelope
    start = np.zeros((h, w), np.int64)  # the first position each of them holds
    size = np.zeros(h, np.int64)
    for q in range(w):
        rows = np.flatnonzero(cost[:, q] < NONE)
        first = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            has = size[r] > 0
            todo, r = todo[has], r[has]
            k = place[r, size[r] - 1]
            rise = cost[r, q] - cost[r, k] + weight * (q * q - k * k)
            begin = rise // (2 * weight * (q - k)) + 1  # where q is lower than k for the first time
            hidden = begin <= start[r, size[r] - 1]
            first[todo] = np.where(hidden, 0, begin)
            size[r[hidden]] -= 1
            todo = todo[hidden]
        kept = first < w
        rows, first = rows[kept], np.maximum(first[kept], 0)
        place[rows, size[rows]] = q
        start[rows, size[rows]] = first
        size[rows] += 1
    number = np.zeros((h, w), np.int64)
    held = np.arange(w) < size[:, None]
    r, k = np.nonzero(held)
    number[r, start[r, k]] = k
    number = np.maximum.accumulate(number, axis=1)
    at = np.take_along_axis(place, number, axis=1)
    out = np.take_along_axis(cost, at, axis=1) + weight * (np.arange(w) - at) ** 2
    return np.where(size[:, None] > 0, out, NONE)


def pixel_weights(dy: float, dx: float) -> tuple[int, int, float]:
    """(weight of a row step, of a column step, length of a unit): squared steps in whole units."""
    ratio = Fraction(dy / dx).limit_denominator(1000)
    return ratio.numerator**2, ratio.denominator**2, dx / ratio.denominator


def nearest_number(number: np.ndarray, dy: float, dx: float, reach: float) -> np.ndarray:
    """Of each cell, the number (> 0) of the closest numbered cell within ``reach``; the smallest of equally close ones, 0 if none."""
    wy, wx, unit = pixel_weights(dy, dx)
    values, rank = np.unique(number[number > 0], return_inverse=True)
    if not len(values):
        return np.zeros_like(number)
    scale = len(values)  # squared distances first, then the rank of the number
    cost = np.full(number.shape, NONE, np.int64)
    cost[number > 0] = rank
    down = envelope(np.ascontiguousarray(cost.T), wy * scale).T
    best = envelope(np.ascontiguousarray(down), wx * scale)
    near = (best < NONE) & (best // scale <= np.floor((reach / unit) ** 2 + 1e-6))
    return np.where(near, values[np.where(near, best % scale, 0)], 0)
