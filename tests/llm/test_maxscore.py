from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.llm import maxscore


def brute(rows, every, k, scale):
    kept = [
        (i, [int(np.floor(x * scale)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, q in kept:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 1e5, 1e6])
def test_top_k_is_exact(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * size).tolist()) for i in range(300)]
    if size < 1e6:
        rows += [(1000 + i, rows[7][1]) for i in range(20)]  # ties
        rows += [(2000, [0.0] * 12), (2001, rows[3][1][:4])]
    rows += [(3000, None), (3001, [1.0, None]), (3002, [float("nan")] * 12), (3003, [float("inf")] * 12), (None, [1.0] * 12)]
    scale = 256.0
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))
    got = maxscore.top_k(df, every=10, k=5, scale=scale, shard_rows=60, query_rows=9).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 5, scale)


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [])]
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, 5, 4.0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 24), (0, 2, 2, 0), (2, 1, 0, 0), (2, 2, 1, 0)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.top_k(empty, 2, 5, 4.0).count() == 0


def test_many_equal_vectors_stay_k_rows_a_shard(spark):
    rows = np.tile(np.array([[1, 2, 3]]), (5000, 1))
    ids = np.random.default_rng(1).permutation(5000)
    query, row, score = maxscore.best_of_shard(ids, rows, np.array([3, 4000]), rows[:2], 5)
    assert len(query) == 10 and set(score) == {14}
    assert [sorted(ids[row[query == n]]) for n in (0, 1)] == [[0, 1, 2, 4, 5], [0, 1, 2, 3, 4]]
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5000)], "vec_id long, embedding array<double>")
    got = maxscore.top_k(same, every=500, k=5, scale=256.0, shard_rows=600).collect()
    assert len(got) == 50 and {r.vec_id for r in got} == {0, 1, 2, 3, 4, 5}
