from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftfield.llm import attention, language_model
from driftfield.llm.encode import load_tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = 50256


@pytest.fixture(scope="module")
def classes():
    rng = np.random.default_rng(0)
    return attention.Classes.from_counts(rng.integers(0, 50, 3000))


def test_gradients_match_differences(classes):
    rng = np.random.default_rng(1)
    model = {k: v.astype(np.float64) for k, v in attention.fresh(classes).items()}
    for k in model:
        model[k] += rng.normal(size=model[k].shape) * 0.1
    x, y = rng.integers(0, classes.size, (2, 2, 7))
    asked = rng.random((2, 7)) < 0.8
    _, grads = attention.gradients(model, x, y, asked)
    for name in attention.SHAPES:
        hot = np.argsort(-np.abs(grads[name]).ravel())[:4]
        for at in hot:
            old = model[name].flat[at]
            values = []
            for step in (1e-5, -1e-5):
                model[name].flat[at] = old + step
                values.append(attention.gradients(model, x, y, asked)[0])
            model[name].flat[at] = old
            assert np.isclose((values[0] - values[1]) / 2e-5, grads[name].flat[at], rtol=1e-3, atol=1e-7), name


def whole_windows(later, first, seed):
    """Inputs, targets and asked positions of full windows, ``later`` ones without their overlap."""
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 1024, (2, later + first, attention.WINDOW))
    asked = np.ones(x.shape, bool)
    asked[rng.permutation(len(x))[:later], : attention.WINDOW - attention.STRIDE] = False
    return x, y, asked


@pytest.mark.parametrize(("later", "first"), [(4, 0), (3, 2), (0, 2)])
def test_gradient_of_whole_windows_matches_a_difference(classes, later, first):
    rng = np.random.default_rng(2)
    model = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in attention.fresh(classes).items()}
    x, y, asked = whole_windows(later, first, 5)
    asked[0, 40:] = False  # a text that ends
    _, grads = attention.gradients(model, x, y, asked)
    for name in attention.SHAPES:
        way = rng.normal(size=model[name].shape)
        losses = [attention.gradients(model | {name: model[name] + step * way}, x, y, asked)[0] for step in (1e-5, -1e-5)]
        assert np.isclose((losses[0] - losses[1]) / 2e-5, (grads[name] * way).sum(), rtol=1e-3, atol=1e-7), name


def test_steps_look_back_at_overlaps_but_ask_nothing_there(classes, monkeypatch):
    x, y, asked = whole_windows(5, 2, 8)
    sizes, exp = [], attention._exp
    monkeypatch.setattr(attention, "_exp", lambda z: sizes.append(z.size) or exp(z))
    attention.gradients(attention.fresh(classes), x, y, asked)
    overlap, t = attention.WINDOW - attention.STRIDE, attention.WINDOW
    assert sum(sizes) == 7 * attention.STRIDE * t + 2 * overlap**2 + 2 * attention.GROUP * asked.sum()


def test_embedding_gradient_is_summed_by_place():
    rng = np.random.default_rng(3)
    at, values = rng.integers(0, 40, 900), rng.normal(size=(900, 5))
    want = np.zeros((50, 5))
    np.add.at(want, at, values)
    assert np.allclose(attention._row_sums(at, values, 50), want)
    assert not attention._row_sums(at[:0], values[:0], 50).any()


def test_probabilities_sum_to_one_and_look_back_only(classes):
    model = attention.fresh(classes)
    n = len(classes.of)
    x = np.tile(np.array([[classes.size, 3, 5, 700]]), (n, 1))
    target = np.tile(np.arange(n)[:, None], (1, 4))
    asked = np.zeros((n, 4), bool)
    asked[:, 2] = True
    p = attention.log_probability(model, classes, x, target, asked)
    assert np.isclose(np.exp(p).sum(), 1.0, atol=1e-3)
    x[:, 3] = 9
    assert np.allclose(p, attention.log_probability(model, classes, x, target, asked))


def test_every_token_is_scored_once(classes):
    lengths = np.array([1, 0, 31, 32, 33, 58, 59, 500])
    doc, start = attention.window_starts(lengths)
    ids = np.arange(lengths.sum()) % 3000
    _, target, asked = attention.windows(ids, lengths, classes, doc, start)
    assert np.array_equal(np.sort(target[asked]), np.sort(ids))
    whole = attention.score(attention.fresh(classes), classes, ids, lengths)
    alone = attention.score(attention.fresh(classes), classes, ids[-500:], np.array([500]))
    assert np.isclose(whole[-1], alone[0]) and whole[1] == 0


def test_tokens_of_later_windows_see_enough_before_them(classes):
    doc, start = attention.window_starts(np.array([500]))
    _, _, asked = attention.windows(np.arange(500), np.array([500]), classes, doc, start)
    assert asked[1:].argmax(axis=1).min() >= 16


def test_overlaps_are_only_looked_back_at(classes, monkeypatch):
    rng = np.random.default_rng(4)
    model, lengths = attention.fresh(classes), np.array([3, 700, 0, 64, 65, 200])
    ids = rng.integers(0, 3000, lengths.sum())
    doc, start = attention.window_starts(lengths)
    x, y, asked = attention.windows(ids, lengths, classes, doc, start)
    whole = attention.log_probability(model, classes, x, y, asked)
    want = np.bincount(np.repeat(doc, asked.sum(axis=1)), whole, len(lengths)) / np.log(10)
    worked, hidden = [], attention._hidden
    monkeypatch.setattr(attention, "_hidden", lambda *a: worked.append(hidden(*a)) or worked[-1])
    assert np.allclose(attention.score(model, classes, ids, lengths), want, rtol=1e-5)
    positions = sum(out[-1].shape[0] * out[-1].shape[1] for out in worked)
    assert positions == (start == 0).sum() * attention.WINDOW + (start > 0).sum() * attention.STRIDE


def test_steps_are_those_of_adam_and_keep_no_denormal_numbers(classes, monkeypatch):
    rng = np.random.default_rng(6)
    model = attention.fresh(classes)
    trainer, seen = attention.Trainer(model), 12
    draws = [{k: (rng.normal(size=v.shape) * 1e-4).astype(np.float32) for k, v in model.items()} for _ in range(seen)]
    nothing = {k: np.zeros_like(v) for k, v in model.items()}
    given = iter(draws + [nothing] * 1000)
    monkeypatch.setattr(attention, "gradients", lambda *a: (0.0, {k: v.copy() for k, v in next(given).items()}))
    want = {k: v.astype(np.float64) for k, v in model.items()}
    first, second = ({k: np.zeros_like(v) for k, v in want.items()} for _ in range(2))
    for n, draw in enumerate(draws, 1):
        trainer.step(None, None, None)
        for k, g in draw.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * np.square(g, dtype=np.float64)
            rate = attention.RATE * min(1, n / 10)
            want[k] -= rate * np.sqrt(1 - 0.99**n) / (1 - 0.9**n) * first[k] / (np.sqrt(second[k]) + 1e-7)
    assert all(np.allclose(trainer.model[k], want[k], atol=1e-5) for k in want)
    for _ in range(1000):
        trainer.step(None, None, None)
    sums = np.concatenate([np.ravel(z) for part in (trainer.first, trainer.second) for z in (part.values() if isinstance(part, dict) else [part])])
    assert not ((sums != 0) & (np.abs(sums) < np.finfo(np.float32).tiny)).any()


def words(text):
    return re.findall(r"[^ \t\n\v\f\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_base_and_tokens_match_a_plain_count(spark, ws, trouble):
    held = F.col("doc_id") % 3 == 0
    df = trouble.withColumns({"block": F.lit(1), "held": F.lit("x")})
    got = language_model.score_texts(df, ws, PATH, held, END).collect()
    rows = trouble.collect()
    assert len(got) == len(rows)
    train = [r for r in rows if r.doc_id is not None and r.doc_id % 3]
    counts = Counter(w for r in train for w in words(r.text))
    counts[None] = len(train)
    n, v = sum(counts.values()), len(counts)
    want = []
    tokenizer = load_tokenizer(PATH)
    for r in rows:
        w = [*words(r.text), None]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        size = sum(len(tokenizer.encode(" " + x, add_special_tokens=False).ids) for x in w[:-1]) + 1
        want.append((str(r.doc_id), r.doc_id is None or r.doc_id % 3 == 0, len(w), sum(x in counts for x in w), n, round(base, 6), size))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.n_subwords) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_training_helps_on_held_out_texts(spark, ws):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    stage = ws.write(language_model.blocks(df, held, PATH, "doc_id", "text"), "blocks")
    counts = np.zeros(50257, np.int64)
    for r in stage.select(F.explode(F.arrays_zip("id", "id_train")).alias("p")).groupBy("p.id").agg(F.sum("p.id_train").alias("n")).collect():
        counts[r.id] = r.n
    own = attention.Classes.from_counts(counts)
    model = language_model.trained(stage, own, END, int(counts.sum()), rounds=1, share=24)
    row = stage.select("counts", "numbers", "word_ids", F.size("words").alias("words"), "held").first()
    ids, lengths = language_model._texts(
        *(language_model._unzip(bytes(row[c]), "<i4") for c in ("counts", "numbers", "word_ids")), row.words, END, np.asarray(row.held)
    )
    some = slice(0, 40)
    ids = ids[: lengths[some].sum()]
    assert attention.score(model, own, ids, lengths[some]).sum() > 0.9 * attention.score(attention.fresh(own), own, ids, lengths[some]).sum()


def first_counts(stage):
    counts = np.zeros(50257, np.int64)
    for r in stage.select(F.explode(F.arrays_zip("id", "id_train")).alias("p")).groupBy("p.id").agg(F.sum("p.id_train").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def test_every_training_window_enters_one_step(spark, ws, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stage = ws.write(language_model.blocks(df, F.col("doc_id") % 5 == 0, PATH, "doc_id", "text"), "blocks")
    counts = first_counts(stage)
    counts[END] += df.where("doc_id % 5 != 0").count()
    own, asked_for, held = attention.Classes.from_counts(counts), [], []

    class Recorder(attention.Trainer):
        def step(self, x, y, asked):
            asked_for.append(np.bincount(y[asked], minlength=own.size))
            self.steps += 1

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)

    class Here:
        """The stage, with the learning done in this process."""

        sparkSession = spark
        select = coalesce = lambda self, *a: self

        def mapInArrow(self, learn, schema):
            columns = ["block", "held", "counts", "numbers", "word_ids", F.size("words").alias("words")]
            return list(learn(iter(stage.select(*columns).toArrow().to_batches())))

    def steps_of(rounds):
        held.append(sum(b.column(1)[0].as_py() for b in rounds))

    monkeypatch.setattr(attention, "Trainer", Recorder)
    monkeypatch.setattr(language_model, "TaskContext", Task)
    monkeypatch.setattr(language_model, "_averaged", steps_of)
    monkeypatch.setattr(language_model, "HELD_WINDOWS", 500, raising=False)  # several fills, and a rest
    language_model.trained(Here(), own, END, int(counts.sum()))
    assert len(held) > 1 and all(held)
    assert np.array_equal(sum(asked_for), np.bincount(own.of, counts, own.size))  # each training token, once


def test_production_training_helps_on_held_out_texts(spark, ws):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    stage = ws.write(language_model.blocks(df, held, PATH, "doc_id", "text"), "blocks")
    counts = first_counts(stage)
    own = attention.Classes.from_counts(counts)
    model = language_model.trained(stage, own, END, int(counts.sum()))
    row = stage.select("counts", "numbers", "word_ids", F.size("words").alias("words"), "held").first()
    ids, lengths = language_model._texts(
        *(language_model._unzip(bytes(row[c]), "<i4") for c in ("counts", "numbers", "word_ids")), row.words, END, np.asarray(row.held)
    )
    assert attention.score(model, own, ids, lengths).sum() > 0.8 * attention.score(attention.fresh(own), own, ids, lengths).sum()


def test_nothing(spark, ws):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score_texts(empty, ws, PATH, F.lit(False), END).count() == 0
