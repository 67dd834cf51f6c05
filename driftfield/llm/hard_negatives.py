"""Hard negatives by a secondary-sort shuffle over packed pair scores.

An anchor's positives are its ``positives`` best other rows of its own label.  A positive with
score p opens the window of scores s with ``least * p <= 100 * s <= most * p``; its hard
negatives are the first ``negatives`` rows of another label in that window.  Rows are ordered by
descending integer inner product with the anchor, ties by ascending id.

1. Shards of rows meet blocks of anchors, each pair of them in a task of its own (a stated
   query set against all rows).  A shard keeps an anchor's best rows of its own label; the
   best of all shards are its positives.
2. Shards and blocks meet again, now with the windows.  A shard keeps the first rows of every
   window, at most ``positives * negatives`` an anchor, whatever ties there are.
3. Windows and scores become byte keys (anchor, descending score, kind, id), dealt by anchor
   and sorted by ``repartitionAndSortWithinPartitions``.  One pass over a partition opens an
   anchor's windows as their upper ends come by, hands every row to the open ones, and closes
   them when they are full or their lower end has passed; an anchor's rows are never held.

Rows whose id or label is null, or whose vector is null or holds null or non-finite components,
take no part.  Vectors of different lengths are filled with zeros.  An anchor's own id is never
its candidate.  Other repeated rows are rows of their own; of rows that repeat an anchor's id
the smallest by label and vector asks.  A positive with a negative score has an empty window.
Scores beyond the range of a long are cut to it.  Empty tables give an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.workspace import Workspace

SHARD_ROWS = 8192
ANCHOR_ROWS = 2048
#: Anchors whose scores against a shard are held at a time.
TOGETHER = 128
#: Key of a pair: anchor and id moved to be unsigned, score counted down from the largest long.
KEY = struct.Struct(">QQBQ")
_MIDDLE = 1 << 63
_WINDOW, _ROW = 0, 1

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(vectors: DataFrame, scale: float, label: Column, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q holds floor(scale * x)."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & label.isNotNull() & F.col(embedding).isNotNull() & sound).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"),
    )


def padded(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of at least ``width`` columns, filled with zeros."""
    flat = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    size = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def inner_products(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first anchor, scores of some anchors against all rows), exact."""
    reach = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(rows.shape[1], 1)
    kind = np.float64 if reach < 2**53 else np.int64 if reach < 2**63 else object
    across = rows.T.astype(kind)
    for k in range(0, len(anchors), TOGETHER):
        found = anchors[k : k + TOGETHER].astype(kind) @ across
        yield k, np.clip(found, -_MIDDLE, _MIDDLE - 1).astype(np.int64) if kind is object else found.astype(np.int64)


def first_of(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` members of ``at`` with the highest scores, earlier members first where scores are equal."""
    if len(at) > k:
        own = score[at]
        least = np.partition(own, len(own) - k)[len(own) - k]
        above, equal = at[own > least], at[own == least]
        at = np.sort(np.concatenate([above, equal[: k - len(above)]]))
    return at[np.argsort(-score[at], kind="stable")]


def _meet(
    rows: DataFrame, anchors: DataFrame, shard_rows: int, anchor_rows: int, sizes: tuple[int, int], use: Callable, schema: str
) -> DataFrame:
    """``use(shard, block)`` for every shard of rows and block of anchors."""
    shards, blocks = max(1, -(-sizes[0] // shard_rows)), max(1, -(-sizes[1] // anchor_rows))
    own = F.xxhash64("vec_id")
    dealt = rows.withColumn("shard", F.pmod(own, F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asking = anchors.withColumn("block", F.pmod(own, F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    return dealt.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInArrow(use, schema)


def _sides(shard: pa.Table, block: pa.Table):
    """Ids, labels and vectors of a shard in ascending order of ids, and of a block."""
    shard = shard.sort_by("vec_id")
    rows = padded(shard["q"], 0)
    anchors = padded(block["q"], rows.shape[1])
    rows = np.pad(rows, ((0, 0), (0, anchors.shape[1] - rows.shape[1])))
    ids, labels = shard["vec_id"].to_numpy(), shard["label"].to_numpy()
    return ids, labels, rows, block["vec_id"].to_numpy(), block["label"].to_numpy(), anchors


def _best_alike(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if shard.num_rows and block.num_rows:
            ids, labels, rows, asks, own, anchors = _sides(shard, block)
            for label in np.unique(own):
                mine, theirs = np.flatnonzero(own == label), np.flatnonzero(labels == label)
                for first, scores in inner_products(anchors[mine], rows[theirs]):
                    for a, score in zip(mine[first:], scores):
                        best = first_of(score, np.flatnonzero(ids[theirs] != asks[a]), k)
                        found.append((np.full(len(best), asks[a]), ids[theirs][best], score[best]))
        anchor, row, score = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"anchor_id": anchor, "positive_id": row, "score": score})

    return search


def window_of(score: int, least: int, most: int) -> tuple[int, int]:
    """(lowest, highest) score of a positive's window."""
    return -(-least * score // 100), most * score // 100


def _first_in_windows(k: int, least: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if shard.num_rows and block.num_rows:
            ids, labels, rows, asks, own, anchors = _sides(shard, block)
            opened = block["scores"].to_pylist()
            for first, scores in inner_products(anchors, rows):
                for a, score in enumerate(scores, first):
                    other = np.flatnonzero((labels != own[a]) & (ids != asks[a]))
                    kept = []
                    for p in set(opened[a]):
                        low, high = window_of(p, least, most)
                        kept.append(first_of(score, other[(score[other] >= low) & (score[other] <= high)], k))
                    kept = np.unique(np.concatenate(kept))
                    found.append((np.full(len(kept), asks[a]), ids[kept], score[kept]))
        anchor, row, score = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"anchor_id": anchor, "negative_id": row, "score": score})

    return search


def packed(anchor: int, score: int, kind: int, number: int) -> bytes:
    """A key whose byte order is (anchor, descending score, kind, number)."""
    return KEY.pack(anchor + _MIDDLE, _MIDDLE - 1 - score, kind, number + _MIDDLE)


def opened_windows(pairs: Iterable[tuple[bytes, tuple]], k: int, least: int) -> Iterator[tuple]:
    """Result rows from keys in order; what is held of an anchor are its open windows."""
    current, windows = None, []
    for key, value in pairs:
        anchor, score, kind, number = KEY.unpack(key)
        if anchor != current:
            current, windows = anchor, []
        if kind == _WINDOW:
            windows.append([*value, 0])
            continue
        score = _MIDDLE - 1 - score
        kept = []
        for window in windows:
            positive, positive_score, taken = window
            if 100 * score < least * positive_score:
                continue
            window[2] = taken + 1
            yield anchor - _MIDDLE, positive, taken + 1, number - _MIDDLE, positive_score, score
            if window[2] < k:
                kept.append(window)
        windows = kept


def mine(
    vectors: DataFrame,
    ws: Workspace,
    every: int,
    positives: int,
    negatives: int,
    scale: float,
    least: int = 50,
    most: int = 95,
    label: Column | None = None,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = ws.write(prepared(vectors, scale, F.col("label") if label is None else label, vec_id, embedding), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row"))
    anchors = ws.write(asked.select("vec_id", "row.*"), "anchors")
    sizes = rows.count(), anchors.count()
    alike = _meet(rows, anchors, shard_rows, anchor_rows, sizes, _best_alike(positives), "anchor_id long, positive_id long, score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = alike.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    chosen = ws.write(chosen.where("score >= 0"), "positives")  # below zero a window is empty
    opened = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("score").alias("scores"))
    near = _meet(
        rows, anchors.join(opened, "vec_id"), shard_rows, anchor_rows, sizes,
        _first_in_windows(negatives, least, most), "anchor_id long, negative_id long, score long",
    )

    def window(row) -> tuple[bytes, tuple | None]:
        high = window_of(row.score, least, most)[1]
        return packed(row.anchor_id, high, _WINDOW, row.place), (row.positive_id, row.score)

    def scored(row) -> tuple[bytes, tuple | None]:
        return packed(row.anchor_id, row.score, _ROW, row.negative_id), None

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = chosen.rdd.map(window).union(near.rdd.map(scored))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(ordered.mapPartitions(lambda pairs: opened_windows(pairs, negatives, least)), RESULT)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(x::DOUBLE * 256) FOR x IN embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE alike),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
        AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
      WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
