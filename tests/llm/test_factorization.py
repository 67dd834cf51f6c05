from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftfield.llm import factorization as fm


def pair_data(n, rng):
    """Label 1 only where an insult meets a group's name: additive weights cannot tell."""
    terms, labels = [], []
    for _ in range(n):
        insult, group = (rng.random(2) < 0.5).tolist()
        t = [10] * insult + [20] * group + rng.integers(100, 130, 3).tolist()
        terms.append(np.unique(np.asarray(t, np.int64)))
        labels.append(float(insult and group))
    return terms, np.asarray(labels)


def test_learns_a_pairwise_interaction():
    terms, labels = pair_data(3000, np.random.default_rng(0))
    m = fm.fit(terms, labels, buckets=256, epochs=30)
    held, want = pair_data(500, np.random.default_rng(1))
    got = m.score(np.repeat(np.arange(500), [len(t) for t in held]), np.concatenate(held), 500)
    assert ((got >= 0.5) == (want > 0)).mean() > 0.99
    assert m.factor[10] @ m.factor[20] > 0


def test_a_pair_in_long_texts_at_production_settings():
    """An insult with a group's name among hundreds of terms: the pairs see what weights alone do not."""

    def texts(n, rng):
        terms, labels = [], []
        for _ in range(n):
            insult, group = (rng.random(2) < 0.5).tolist()
            terms.append(np.unique(np.array([10] * insult + [20] * group + rng.integers(1000, 6000, 300).tolist())))
            labels.append(float(insult and group))
        return terms, np.asarray(labels)

    def loss(m):
        p = m.score(*at)
        return -np.mean(want * np.log(p) + (1 - want) * np.log(1 - p))

    rng = np.random.default_rng(0)
    known = texts(4000, rng)
    held, want = texts(800, rng)
    at = np.repeat(np.arange(800), [len(t) for t in held]), np.concatenate(held), 800
    m, linear = fm.fit(*known), fm.fit(*known, factors=0)
    pairs = m.raw(*at) - fm.Machine(m.bias, m.weight, np.zeros_like(m.factor)).raw(*at)
    assert m.factor[10] @ m.factor[20] > 1
    assert loss(m) < loss(linear) - 0.01
    assert pairs[want > 0].mean() > pairs[want == 0].mean() + 0.1


def test_score_is_the_pairwise_sum():
    rng = np.random.default_rng(2)
    m = fm.Machine(0.3, rng.normal(size=8), rng.normal(size=(8, 3)))
    docs = [np.array([0, 3, 5]), np.array([], int), np.array([7])]
    got = m.raw(np.repeat(np.arange(3), [len(d) for d in docs]), np.concatenate(docs).astype(int), 3)
    for d, g in zip(docs, got):
        pairs = sum(m.factor[a] @ m.factor[b] for k, a in enumerate(d) for b in d[k + 1 :])
        assert np.isclose(g, 0.3 + m.weight[d].sum() + pairs / max(1, len(d)))
    again = fm.Machine.unpack(m.pack(), 8)
    assert np.allclose(again.weight, m.weight, atol=1e-6) and np.allclose(again.factor, m.factor, atol=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = fm.scored(docs.select("doc_id", "text"), fm.learn(docs, labels, ~held))
    rows = out.join(labels.where(held), "doc_id").select("score", "toxic", "text").toPandas()
    said, toxic = rows.score >= 0.3, rows.toxic == 1
    assert (said & toxic).sum() / said.sum() > 0.9
    # 64 of the 120 held-out toxic texts hold one of these words and no clean text does; the other 56 labels are noise
    insulting = rows.text.str.lower().str.contains("trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron")
    assert (insulting & ~toxic).sum() == 0 and insulting.sum() < 0.6 * toxic.sum()
    assert (said & insulting).sum() / insulting.sum() > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "you loser"), (1, "you loser"), (2, None), (3, ""), (None, "x " * 50_000), (4, "nice day")], "doc_id long, text string"
    ).withColumns({"score": F.lit("clash"), "_label": F.lit(1)})
    labels = spark.createDataFrame([(1, 1), (1, None), (4, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    machine = fm.learn(docs, labels, F.lit(True))
    out = fm.scored(docs, machine).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    score = {r.doc_id: r.score for r in out}
    assert score[2] == score[3] and out[0].score == out[1].score
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in fm.scored(docs, fm.learn(docs, none, F.lit(True))).collect()} == {0.5}
    assert fm.scored(docs.limit(0), machine).count() == 0
