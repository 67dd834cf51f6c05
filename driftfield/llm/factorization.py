"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words (runs of letters) and their first four and six bytes, hashed to a
fixed number of buckets; a term counts once per text.  Besides a weight per term the model
has a short factor vector per term, and the dot product of two terms' factors is the weight
of their meeting in one text: an insult next to a group's name can weigh more than both.

Training takes labelled documents up to a fixed number (those with the smallest hashes of
their ids), whose terms are extracted in parallel and fitted in one task of bounded size.
Scoring runs where the texts are, block by block, with a model of fixed size.

Null and empty texts have no terms and get the score of the intercept. Repeated rows are
scored alike. Documents labelled more than once count as toxic if one label says so; null
labels count as none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.llm.encode import small_batches
from driftfield.llm.words import LETTERS, Words, mix, word_blocks

BUCKETS = 1 << 18
PREFIXES = (4, 6)
FACTORS = 4
#: Labelled documents that take part in training (a bounded sample; all, where there are fewer).
SAMPLE = 12_000
EPOCHS = 4
BATCH = 64
RATE = 0.1
#: Pull towards zero that a term's weight, and its factors, get in an epoch, however many texts it is in.
DECAY = 8.0
FACTOR_DECAY = 0.05
#: Spread of the factors at the start, and what their squared gradients start from (small, as a pair's share of a text is).
SPREAD = 0.1
FACTOR_START = 1e-2
SEED = 20_240_601


def term_buckets(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every distinct term, ordered."""
    owner = words.owner()
    kinds = [words.hashes(), *(words.hashes(p) for p in PREFIXES)]
    keys = [
        owner * buckets + (mix(h + np.uint64(k)) % np.uint64(buckets)).astype(np.int64) for k, h in enumerate(kinds)
    ]
    both = np.unique(np.concatenate(keys))
    return both // buckets, both % buckets


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the dot products of factors / number of terms)."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, owner: np.ndarray, bucket: np.ndarray, docs: int) -> np.ndarray:
        linear = np.bincount(owner, self.weight[bucket], docs)
        count = np.maximum(np.bincount(owner, minlength=docs), 1)
        pairs = np.zeros(docs)
        for f in range(self.factor.shape[1]):
            v = self.factor[bucket, f].astype(np.float64)
            pairs += np.bincount(owner, v, docs) ** 2 - np.bincount(owner, v * v, docs)
        return self.bias + linear + 0.5 * pairs / count

    def score(self, owner: np.ndarray, bucket: np.ndarray, docs: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(owner, bucket, docs), -40, 40)))

    def pack(self) -> bytes:
        return np.concatenate([[self.bias], self.weight, self.factor.ravel()]).astype("<f4").tobytes()

    @classmethod
    def unpack(cls, raw: bytes, buckets: int = BUCKETS) -> Machine:
        a = np.frombuffer(raw, "<f4")
        return cls(float(a[0]), a[1 : 1 + buckets].copy(), a[1 + buckets :].reshape(buckets, -1).copy())


def fit(
    terms: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, factors: int = FACTORS, epochs: int = EPOCHS
) -> Machine:
    """Adagrad on the logistic loss, in small batches in a fixed random order.

    A term is pulled back as much in each epoch as all others, spread over the texts it is in,
    so rare terms stay small and common ones follow the labels.
    """
    rng = np.random.default_rng(SEED)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-4, 1 - 1e-4)
    weight = np.zeros(buckets, np.float32)
    factor = np.zeros((buckets, factors), np.float32)
    bias = float(np.log(share / (1 - share)))
    seen = np.bincount(np.concatenate(terms), minlength=buckets) if terms else np.zeros(buckets, int)
    met = np.flatnonzero(seen)
    number = np.full(buckets, -1)
    number[met] = np.arange(len(met))
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    terms = [number[t] for t in terms]
    texts = seen[met].astype(float)
    w, v = np.zeros(len(met)), rng.normal(0, SPREAD, (len(met), factors))
    w_sum, v_sum, b_sum = np.full(len(w), 1.0), np.full(v.shape, FACTOR_START), 1.0
    for _ in range(epochs if len(met) else 0):
        order = rng.permutation(len(terms))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            at_doc = np.repeat(np.arange(len(part)), [len(terms[k]) for k in part])
            bucket = np.concatenate([terms[k] for k in part])
            own, place = np.unique(bucket, return_inverse=True)
            x = np.zeros((len(part), len(own)))
            x[at_doc, place] = 1.0
            n = np.maximum(size[part], 1)[:, None]
            wo, vo = w[own], v[own]
            sums = x @ vo
            raw = bias + x @ wo + 0.5 * ((sums**2 - x @ vo**2) / n).sum(axis=1)
            wrong = 1.0 / (1.0 + np.exp(-np.clip(raw, -40, 40))) - labels[part]
            part_of_epoch = x.sum(axis=0) / texts[own]
            g = wrong @ x + DECAY * part_of_epoch * wo
            scaled = x * (wrong[:, None] / n)
            gv = scaled.T @ sums - scaled.sum(axis=0)[:, None] * vo + FACTOR_DECAY * part_of_epoch[:, None] * vo
            w_sum[own] += g**2
            v_sum[own] += gv**2
            w[own] -= RATE * g / np.sqrt(w_sum[own])
            v[own] -= RATE * gv / np.sqrt(v_sum[own])
            b_sum += float(wrong.sum()) ** 2
            bias -= RATE * float(wrong.sum()) / np.sqrt(b_sum)
    weight[met], factor[met] = w, v
    return Machine(bias, weight, factor)


def learn(
    documents: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Machine:
    """The machine of at most ``sample`` labelled documents for which ``usable`` (of the label's row) holds."""
    spark = documents.sparkSession
    small_batches(spark)
    marked = (
        labels.where(usable & F.col(doc).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc).cast("long").alias("_doc"))
        .agg(F.max(F.col(label).cast("double")).alias("_label"))
        .orderBy(F.xxhash64("_doc"), "_doc")
        .limit(sample)
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in word_blocks(batch.column(2), kind=LETTERS):
                owner, bucket = term_buckets(words)
                first = np.searchsorted(owner, np.arange(words.docs + 1))
                packed = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, to - at) for c in (0, 1)), pa.array(packed, pa.binary())],
                    names=["_doc", "_label", "_terms"],
                )

    def train(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_doc", "ascending"), ("_terms", "ascending")])
        terms = [np.frombuffer(t.as_py(), "<i4").astype(np.int64) for t in rows["_terms"]]
        return pa.table({"machine": [fit(terms, rows["_label"].to_numpy()).pack()]})

    chosen = documents.select(F.col(doc).cast("long").alias("_doc"), F.col(text).alias("_text"))
    chosen = chosen.join(F.broadcast(marked), "_doc").select("_doc", "_label", "_text")  # at most ``sample`` numbers
    terms = chosen.mapInArrow(extract, "_doc long, _label double, _terms binary")
    got = terms.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(train, "machine binary").collect()
    return Machine.unpack(bytes(got[0].machine)) if got else Machine(0.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))


def scored(documents: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``documents`` with a column ``out``: the probability that the text is toxic."""
    spark = documents.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(machine.pack())
    at_text = documents.columns.index(text)
    place = documents.columns.index(out) if out in documents.columns else None
    kept = [c for k, c in enumerate(documents.columns) if k != place]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine.unpack(model.value)
        for batch in batches:
            values = [np.zeros(0)]
            for _, _, words in word_blocks(batch.column(at_text), kind=LETTERS):
                owner, bucket = term_buckets(words)
                values.append(own.score(owner, bucket, words.docs))
            columns = [c for k, c in enumerate(batch.columns) if k != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(values))], names=[*kept, out])

    schema = documents.select(*kept).withColumn(out, F.lit(0.0)).schema
    return documents.mapInArrow(score, schema)
