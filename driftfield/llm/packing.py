"""Best-fit packing of documents into sequences of a fixed capacity.

Best fit decreasing over a histogram, on the driver, in place of distributed successor sweeps:
Spark counts the documents of each length and ranks them within it, one sequential loop on
the driver matches the counts to gaps, and Spark joins the documents to the result.  The loop
takes the lengths from the longest down and fills the gaps upward from the smallest that
still holds a length; documents no gap can take open new sequences.

Documents of one length are interchangeable, and so are sequences with one history.
The loop therefore works on runs of ranks (at most a few for each length and gap, however
many documents there are), and the documents meet their runs in a single join by length
and rank.  Counts per length are combined before the shuffle; ranks within a length come
from bucket counts, so a length that a third of all rows share is spread over tasks.

Null and empty texts are the end id alone. Repeated rows are separate documents. A longer
document is cut every ``capacity`` ids, and nothing else is. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.llm.encode import encoded_blocks, small_batches
from driftfield.operators.ranking import bucketed_row_number
from driftfield.workspace import Workspace

CAPACITY = 2048
#: Rows of the run table up to which every task gets all of it.
BROADCAST_RUNS = 200_000
_RANGE = 1 << 11

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, the end id included."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, ids, lengths in encoded_blocks(batch.column(1), tokenizer):
                ids = np.insert(ids, np.cumsum(lengths), end_id).astype("<u4")
                lengths = lengths + 1
                pieces = -(-lengths // capacity)
                owner = np.repeat(np.arange(len(lengths)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                size = np.minimum(lengths[owner] - start, capacity)
                raw, ends = memoryview(ids.tobytes()), np.cumsum(size) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at).take(pa.array(owner)).cast(pa.int64()),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array([zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    small_batches(documents.sparkSession)
    return documents.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(cut, PIECES)


class Gaps:
    """Open sequences as runs (first sequence, how many), by the size of their gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]
        self.sequences = 0

    def take(self, gap: int, most: int) -> tuple[int, int]:
        first, n = self.runs[gap].popleft()
        if n > most:
            self.runs[gap].appendleft((first + most, n - most))
        return first, min(n, most)

    def put(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            self.runs[gap].append((first, n))

    def round(self, length: int, count: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Place ``count`` documents of one length: (length, first rank, end rank, first sequence, offset)."""
        rank, gap = 0, length
        while rank < count:
            while gap <= self.capacity and not self.runs[gap]:
                gap += 1
            if gap > self.capacity:
                n = -(-(count - rank) // (self.capacity // length))
                self.put(self.capacity, self.sequences, n)
                self.sequences += n
                gap = self.capacity
                continue
            first, n = self.take(gap, count - rank)
            yield length, rank, rank + n, first, self.capacity - gap
            self.put(gap - length, first, n)
            rank += n
            if gap - length >= length:
                gap -= length


def best_fit(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """The runs of all rounds for the number of documents of each length."""
    gaps = Gaps(capacity)
    runs = [run for length in sorted(counts, reverse=True) for run in gaps.round(length, counts[length])]
    return pd.DataFrame(runs, columns=["length", "first_rank", "end_rank", "first_sequence", "offset"], dtype="int64")


def pack(pieces: DataFrame, ws: Workspace, capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.  ``pieces`` should be a written table."""
    spark = pieces.sparkSession
    ranked = bucketed_row_number(
        pieces,
        ["length"],
        {"_range": F.coalesce(F.floor(F.col("doc_id") / _RANGE), F.lit(-(1 << 62)))},
        [F.col("doc_id"), F.col("piece")],
        "_rank",
    )
    ranked = ws.write(ranked.withColumn("_rank", F.col("_rank") - 1), "ranked")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = best_fit(counts, capacity)
    table = spark.createDataFrame(
        runs, "length long, first_rank long, end_rank long, first_sequence long, offset long"
    )
    if len(runs) <= BROADCAST_RUNS:
        table = F.broadcast(table)
    return (
        ranked.join(table, "length")
        .where("_rank >= first_rank and _rank < end_rank")
        .withColumn("sequence_id", F.col("first_sequence") + F.col("_rank") - F.col("first_rank"))
        .select(*pieces.columns, "sequence_id", "offset")
    )
