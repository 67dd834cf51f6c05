"""Nearest match in time, and partners of tracks whose times are not quite the same."""

from __future__ import annotations

import random

import pytest

from driftfield.operators.asof import nearest_in_time
from driftfield.operators.stats import track_ends


def match(spark, rows, candidates, tolerance=1.0):
    left = spark.createDataFrame(rows, "id long, k long, t double")
    right = spark.createDataFrame(candidates, "c long, k long, t double")
    out = nearest_in_time(left, right, ["id"], ["k"], "t", ["c"], tolerance)
    return {r.id: r.c for r in out.collect()}


def test_random_rows_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), rng.choice([rng.uniform(-9, 9), float(rng.randrange(-9, 9))])) for i in range(150)]
    cand = [(i, rng.randrange(4), rng.choice([rng.uniform(-9, 9), rng.randrange(-18, 18) / 2])) for i in range(150)]
    for tolerance in (0.3, 1.0, 2.5):
        want = {}
        for i, k, t in rows:
            near = [(abs(t - u), c) for c, q, u in cand if q == k and abs(t - u) < tolerance]
            if near:
                want[i] = min(near)[1]
        assert match(spark, rows, cand, tolerance) == want


def test_bounds_ties_and_missing_values(spark):
    rows = [(1, 1, 10.0), (2, 1, 20.0), (3, 1, None), (4, None, 10.0), (5, 1, 30.0)]
    cand = [(7, 1, 11.0), (8, 1, 20.5), (9, 1, 19.5), (10, None, 10.0), (11, 1, None), (12, 1, 29.5), (12, 1, 29.5)]
    assert match(spark, rows, cand) == {2: 8, 5: 12}
    assert match(spark, rows, []) == {} == match(spark, [], cand)


def test_a_tolerance_of_nothing_is_an_error(spark):
    with pytest.raises(ValueError, match="more than 0"):
        match(spark, [], [], 0.0)


@pytest.mark.parametrize("off, found", [(0.0, True), (0.5, True), (-0.5, True), (1.0, False), (1.5, False)])
def test_partners_off_by_part_of_a_second(spark, off, found):
    rows = [(1, i, 3600.0 * i, 10 + i, 1, None, None) for i in range(4)]
    rows += [(2, 0, 0.0 + off, 50, 21, None, None), (2, 1, 3600.0 + off, 51, 21, 1, None)]
    rows += [(3, 0, 7200.0 + off, 60, 31, None, 1)]
    series = spark.createDataFrame(
        rows,
        "track_id long, time_idx int, base_time double, cloudnumber int, track_status int, merge_track long, split_track long",
    )
    got = {r.track_id: r for r in track_ends(series).collect()}
    merged = (got[2].end_merge_timeindex, got[2].end_merge_cloudnumber)
    split = (got[3].start_split_timeindex, got[3].start_split_cloudnumber)
    assert (merged, split) == (((2, 12), (1, 11)) if found else ((None, None), (None, None)))
    assert got[1].track_duration == 4 and got[1].end_merge_timeindex is None
