from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftfield.llm import importance
from driftfield.llm.words import word_blocks


def grams(text):
    w = text.lower().split()
    return w + [(a, b) if a != b else "again" for a, b in zip(w, w[1:])]


def test_weights_are_the_log_ratio_of_both_models(spark):
    texts = ["the cat sat on the mat", "the dog sat", "spam spam spam spam", None, "", "spam eggs spam"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chosen = spark.createDataFrame([(0, True, True), (1, True, True), (2, False, True), (5, True, False)], "_doc long, _good boolean, _fit boolean")
    buckets = 1 << 20  # large enough for no two n-grams to meet
    w = importance.learn(docs, chosen, buckets)
    raw = Counter(g for t in texts for g in grams(t or ""))
    target = Counter(g for t in texts[:2] for g in grams(t))
    a = importance.SMOOTHING

    def p(c, g):
        return (c[g] + a) / (sum(c.values()) + a * buckets)

    want = [sum(math.log(p(target, g) / p(raw, g)) for g in grams(t or "")) for t in texts]
    got = {r.doc_id: r.log_ratio for r in importance.weighted(docs, w).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], want)
    assert got[3] == got[4] == 0.0


def test_gumbel_top_k_draws_in_proportion():
    share = np.array([0.5, 0.3, 0.2])
    ids = np.arange(30_000).reshape(3, -1)
    keys = np.log(share)[:, None] + importance.gumbel(ids.ravel()).reshape(ids.shape)
    assert np.allclose(np.bincount(keys.argmax(axis=0), minlength=3) / ids.shape[1], share, atol=0.02)


@pytest.mark.parametrize("values", [[1.0], [2.0] * 50, list(np.random.default_rng(0).normal(size=500)), [0.0, 1e300, -1e300, 1.0, 1.0]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for k in {1, 2, len(values) // 2 + 1, len(values)}:
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]


def test_selection_keeps_good_documents(spark, ws):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    selection, keys = importance.select(docs, labels.where(train), ws)
    rows = keys.join(labels.where(~train), "doc_id").toPandas()
    kept = rows.key >= selection.least_key
    assert kept[rows.quality == 1].mean() > 0.98 and kept[rows.quality == 0].mean() < 0.05
    assert keys.where(F.col("key") >= selection.least_key).count() == selection.k


def test_odd_rows(spark, ws):
    docs = spark.createDataFrame(
        [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, ""), (4, "z " * 30_000)], "doc_id long, text string"
    ).withColumns({"key": F.lit("clash"), "bucket": F.lit(0)})
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (2, None)], "doc_id long, quality int")
    selection, keys = importance.select(docs, labels, ws)
    rows = keys.collect()
    assert len(rows) == 6 and len({r.key for r in rows if r.doc_id == 1}) == 1
    again = importance.weighted(docs, selection.weights).collect()
    assert sorted(r.key for r in again) == sorted(r.key for r in rows)
    none, keys = importance.select(docs, labels.limit(0), ws)
    assert keys.where(F.col("key") >= none.least_key).count() == 6
    empty, keys = importance.select(docs.limit(0), labels, ws)
    assert keys.count() == 0
    half, keys = importance.select(docs, labels, ws, share=0.5)
    assert keys.where(F.col("key") >= half.least_key).count() in (3, 4)
