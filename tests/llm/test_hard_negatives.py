from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, positives, negatives, scale):
    kept = [
        (i, [int(np.floor(x * scale)) for x in v], c)
        for i, v, c in rows
        if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i in sorted({i for i, _, _ in kept if i % every == 0}):
        c, q = min((c, v) for j, v, c in kept if j == i)
        others = sorted((-sum(a * b for a, b in zip(q, v)), j, d) for j, v, d in kept if j != i)
        alike = [(-s, j) for s, j, d in others if d == c][:positives]
        for p, j in alike:
            wanted = [(-s, m) for s, m, d in others if d != c and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(i, j, r + 1, m, p, s) for r, (s, m) in enumerate(wanted)]
    return sorted(out)


def found(spark, ws, rows, every=10, positives=5, negatives=3, scale=256.0, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit("x"), "block": F.lit(1), "score": F.lit(None)})
    return sorted(map(tuple, hn.mine(df, ws, every, positives, negatives, scale, **more).collect()))


@pytest.mark.parametrize("size", [1.0, 1e6])
def test_mined_rows_equal_brute_force(spark, ws, size):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 12))
    rows = [(i, ((base[i % 6] + rng.normal(size=12) * 0.7) * size).tolist(), i % 4) for i in range(400)]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(40)]  # ties
    rows += [(2000, [0.0] * 12, 1), (2010, rows[3][1][:4], 2), (-10, rows[5][1], 1), (7, rows[7][1], 3), (20, rows[20][1], 0)]
    rows += [(3000, None, 1), (3010, [1.0, None], 1), (3020, [float("nan")] * 12, 1), (3030, [float("inf")] * 12, 2)]
    rows += [(None, [1.0] * 12, 1), (3040, [1.0] * 12, None), (3050, [], 1)]
    got = found(spark, ws, rows, shard_rows=70, anchor_rows=9)
    assert got == brute(rows, 10, 5, 3, 256.0) and len(got) > 200


def test_many_equal_vectors_and_one_label(spark, ws):
    """A shard hands on a bounded number of rows, ties or not; without other labels there is nothing to find."""
    rows = [(i, [1.0, 2.0], i % 2) for i in range(500)] + [(600 + i, [0.5, 1.2], i % 2) for i in range(500)]
    assert found(spark, ws, rows, shard_rows=100, anchor_rows=20) == brute(rows, 10, 5, 3, 256.0)
    score = np.zeros(5000, np.int64)
    assert hn.first_of(score, np.arange(5000), 3).tolist() == [0, 1, 2]
    assert found(spark, ws, [(i, [1.0], 0) for i in range(30)]) == []


def test_empty_tables_and_few_rows(spark, ws):
    assert found(spark, ws, []) == []
    rows = [(0, [4.0], 1), (1, [2.0], 1), (2, [1.0], 2), (3, [-1.0], 1)]
    assert found(spark, ws, rows, scale=1.0) == [(0, 1, 1, 2, 8, 4)]


def test_keys_keep_the_order_and_windows_hold_no_rows():
    pairs = [(a, s, k, i) for a in (-5, 0, 3) for s in (-(2**62), -1, 0, 7, 2**62) for k in (0, 1) for i in (-2, 0, 9)]
    in_order = sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))
    assert sorted(pairs, key=lambda p: hn.packed(*p)) == in_order

    def endless():
        yield hn.packed(1, 95, 0, 1), (7, 100)
        for i in range(100_000):
            yield hn.packed(1, 95, 1, i), None

    rows = list(hn.opened_windows(endless(), 3, 50))
    assert rows == [(1, 7, r + 1, r, 100, 95) for r in range(3)]
