"""Quality selection by importance resampling.

Texts are bags of hashed words and word pairs; a word followed by itself is one and the same
pair whatever the word.  Two generative models count these n-grams:
the target model over documents labelled good, the raw model over all documents.  The log of
the ratio of both probabilities of a text is its importance weight; adding Gumbel noise and
taking the k largest sums draws k documents without replacement in proportion to the weights.

The target takes at most ``sample`` labelled documents (those with the smallest hashes of
their ids); raw counts, weights and the k-th largest key cover every document.  Each task
sends one count per bucket at most.  The k-th key is found by counting keys in ever finer
bins, so no ranking passes through one task.  Noise comes from a hash of the document's id
and a seed, so a repeated run, or a task run again, draws the same documents.

``k`` is the share asked for, or else the number of documents above the weight that best
separates the labelled documents that took no part in fitting.  Null and empty texts have weight 0; keys equal to the
k-th are all kept, so repeated rows stay or go together. Without labels everything is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.llm.encode import small_batches
from driftfield.llm.words import Words, mix, word_blocks
from driftfield.workspace import Workspace

BUCKETS = 10_000
SMOOTHING = 0.5
#: Labelled documents that take part (a bounded sample; all, where there are fewer).
SAMPLE = 20_000
SEED = 7
_BINS = 2048


def ngram_buckets(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word and every pair of neighbours."""
    h, owner = words.hashes(), words.owner()
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    both = mix(h[pair] * np.uint64(0xD6E8FEB86659FD93) + h[pair + 1])
    both[h[pair] == h[pair + 1]] = 0
    at = np.concatenate([owner, owner[pair]])
    return at, (np.concatenate([h, both]) % np.uint64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class Weights:
    """Log ratio of the target's and the raw probability of each bucket."""

    ratio: np.ndarray

    def of(self, words: Words) -> np.ndarray:
        owner, bucket = ngram_buckets(words, len(self.ratio))
        return np.bincount(owner, self.ratio[bucket], words.docs)


def labelled_sample(labels: DataFrame, sample: int, doc: str = "doc_id", label: str = "quality") -> DataFrame:
    """(_doc, _good, _fit): at most ``sample`` labelled documents, three quarters of them for fitting; one that any label calls bad is bad."""
    chosen = (
        labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc).cast("long").alias("_doc"))
        .agg((F.min(label) > 0).alias("_good"))
        .orderBy(F.xxhash64("_doc"), "_doc")
        .limit(sample)
    )
    return chosen.withColumn("_fit", F.pmod(F.xxhash64("_doc"), F.lit(4)) != 0)


def learn(documents: DataFrame, chosen: DataFrame, buckets: int = BUCKETS, doc: str = "doc_id", text: str = "text") -> Weights:
    """Both models' counts in one pass over all texts."""
    small_batches(documents.sparkSession)
    good = F.broadcast(chosen.where("_good and _fit").select("_doc", F.lit(True).alias("_target")))  # at most ``sample`` numbers
    rows = documents.select(F.col(doc).cast("long").alias("_doc"), F.col(text).alias("_text")).join(good, "_doc", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            marked = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for at, to, words in word_blocks(batch.column(0)):
                owner, bucket = ngram_buckets(words, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[marked[at:to][owner]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"]
        )

    counts = rows.select("_text", "_target").mapInArrow(count, "bucket long, raw long, target long")
    total = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[total.bucket], target[total.bucket] = total.raw, total.target
    if not target.sum():
        return Weights(np.zeros(buckets))

    def logs(c: np.ndarray) -> np.ndarray:
        return np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * buckets))

    return Weights(logs(target) - logs(raw))


def gumbel(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Noise per id; the same id always gets the same."""
    u = (mix(mix(ids.astype(np.uint64) + np.uint64(seed))) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def weighted(documents: DataFrame, weights: Weights, seed: int = SEED, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with log_ratio and key (log_ratio plus noise) as last columns, in place of any of these names."""
    spark = documents.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(weights.ratio)
    names = documents.columns
    kept = [c for c in names if c not in ("log_ratio", "key")]
    at_doc, at_text = kept.index(doc), kept.index(text)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(model.value)
        for batch in batches:
            parts = [np.zeros(0), *(own.of(words) for _, _, words in word_blocks(batch.column(at_text)))]
            ratio = np.concatenate(parts)
            ids = batch.column(at_doc).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ratio), pa.array(ratio + gumbel(ids, seed))], names=[*kept, "log_ratio", "key"]
            )

    schema = documents.select(*kept).withColumns({"log_ratio": F.lit(0.0), "key": F.lit(0.0)}).schema
    return documents.select(*kept).mapInArrow(weigh, schema)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column (its smallest, where there are fewer), by counts in ever finer bins."""
    span = df.agg(F.min(column).alias("a"), F.max(column).alias("z"), F.count(column).alias("n")).first()
    if not span.n:
        return float("-inf")
    low, high, k = span.a, span.z, min(max(k, 1), span.n)
    while low < high:
        width = (high - low) / _BINS
        within = df.where(F.col(column).between(low, high))
        number = F.least(F.floor((F.col(column) - low) / width), F.lit(_BINS - 1))
        bins = within.groupBy(number.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("z")
        )
        for r in sorted(bins.collect(), key=lambda r: -r.b):  # at most _BINS rows
            if k <= r.n:
                break
            k -= r.n
        if (r.a, r.z) == (low, high):
            break
        low, high = r.a, r.z
    return low if low == high else high


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The value that best separates both groups; half way between its neighbours."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    right = 1 - np.searchsorted(np.sort(good), cuts) / len(good) + np.searchsorted(np.sort(bad), cuts) / len(bad)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


@dataclass(frozen=True)
class Selection:
    weights: Weights
    least_key: float
    k: int


def select(
    documents: DataFrame, labels: DataFrame, ws: Workspace, share: float | None = None, sample: int = SAMPLE
) -> tuple[Selection, DataFrame]:
    """The fitted selection, and (doc_id, log_ratio, key) of every document as a written table."""
    chosen = ws.write(labelled_sample(labels, sample), "labelled")
    weights = learn(documents, chosen)
    keys = ws.write(weighted(documents.select("doc_id", "text"), weights).drop("text"), "weights")
    n = keys.count()
    if share is not None:
        k = round(share * n)
    else:
        known = keys.join(F.broadcast(chosen.where("not _fit")), keys.doc_id == chosen["_doc"]).groupBy("doc_id", "_good").agg(
            F.max("log_ratio").alias("r")
        )
        known = known.toPandas()  # at most ``sample`` rows
        cut = best_cut(known.r[known._good].to_numpy(), known.r[~known._good].to_numpy())
        k = keys.where(F.col("log_ratio") >= cut).count()
    least = kth_largest(keys, "key", k) if k else float("inf")
    return Selection(weights, least, k), keys
