"""Exact top-k by inner product of integer vectors, with MaxScore.

Components are the terms, columns of a shard the postings.  Within a shard a term of a query
contributes between a lower and an upper bound.  Terms are ordered by how far these lie
apart; the first ones are essential: a vector at the lower bound in all of them cannot reach
the threshold even with the upper bounds of the rest.  Essential postings are traversed for
all vectors, the other terms are probed, a few at a time, only for vectors that can still
compete.  The threshold starts from a few fully scored vectors and rises with the lower
bounds of those still competing.  The best of all shards are merged by rank.

Shards and query blocks have fixed sizes; every shard meets every block in a task of its
own, which is the work an exact search over all rows asks for. A shard hands on a query's
k best, ties to the smaller id: the merge uses the same order, so the result is exact.

Vectors that are null, empty of an id, or hold null or non-finite components take no part.
Vectors of different lengths are filled with zeros. Rows with the query's own id are not its
candidates; other repeated rows each are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
QUERY_ROWS = 2048
_SEED = 256
_PROBE = 8


def quantised(vectors: DataFrame, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, q): components as floor(scale * x)."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & sound).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"),
    )


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix, filled with zeros to the longest."""
    lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def best_of_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query, row) numbers and scores of every query's ``k`` best rows, ties to the smaller id."""
    width = max(rows.shape[1], queries.shape[1])
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    reach = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    kind = np.float64 if reach < 2**53 else np.int64 if reach < 2**63 else object
    postings = np.ascontiguousarray(rows.T.astype(kind))
    low, high = postings.min(axis=1, initial=None), postings.max(axis=1, initial=None)
    out = []
    for n, query in enumerate(queries.astype(kind)):
        others = np.flatnonzero(ids != query_ids[n])
        ends = np.stack([query * low, query * high])
        upper, lower = ends.max(axis=0), ends.min(axis=0)
        order = np.argsort(lower - upper, kind="stable")
        query, upper, lower, own = query[order], upper[order], lower[order], order
        above = np.append(np.cumsum(upper[::-1])[::-1], 0)
        below = np.append(np.cumsum(lower[::-1])[::-1], 0)
        seeds = others[:_SEED]
        threshold = kth(query @ postings[own][:, seeds], k) if len(seeds) >= k else None
        essential = width
        if threshold is not None:
            weak = (below[0] - below) + above < threshold
            essential = int(np.argmax(weak)) if weak.any() else width
        essential = max(essential, min(_PROBE, width))
        alive = others
        score = query[:essential] @ postings[own[:essential]][:, alive]
        at = essential
        while True:
            if len(alive) >= k:
                bound = kth(score + below[at], k)
                threshold = bound if threshold is None else max(threshold, bound)
            if threshold is not None:
                still = score + above[at] >= threshold
                alive, score = alive[still], score[still]
            if at >= width:
                break
            to = min(at + _PROBE, width)
            score = score + query[at:to] @ postings[own[at:to]][:, alive]
            at = to
        if len(alive) > k:
            first = np.lexsort((ids[alive], -score))[:k]
            alive, score = alive[first], score[first]
        out.append((np.full(len(alive), n), alive, score))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def top_k(
    vectors: DataFrame,
    every: int,
    k: int,
    scale: float,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all rows for each row whose id ``every`` divides."""
    sound = quantised(vectors, scale)
    asked = sound.where(F.col("vec_id") % every == 0)
    shards = max(1, -(-sound.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    own = F.xxhash64("vec_id")
    candidates = sound.withColumn("shard", F.pmod(own, F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    queries = asked.withColumn("block", F.pmod(own, F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def search(mine: pa.Table, asking: pa.Table) -> pa.Table:
        ids, query_ids = mine["vec_id"].to_numpy(), asking["vec_id"].to_numpy()
        if len(ids) and len(query_ids):
            query, row, score = best_of_shard(ids, _matrix(mine["q"]), query_ids, _matrix(asking["q"]), k)
        else:
            query = row = score = np.zeros(0, np.int64)
        return pa.table({"query_id": query_ids[query], "vec_id": ids[row], "score": score.astype(np.int64)})

    found = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(
        search, "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


ORACLE = """
WITH v AS (SELECT vec_id, [floor(x::DOUBLE * 256) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
