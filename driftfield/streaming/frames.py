"""Gridded frames from a stream of point records.

Every micro-batch writes its own sums per frame and pixel into a folder of its
own, and a pixel's value is the sum over the batches.  No state is kept and no
record is too late; a batch that is written twice replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixel_windows(records: DataFrame, time: str, length: str, y: Column, x: Column, value: str) -> DataFrame:
    """(ts, y, x, value): sums per time window and pixel."""
    return (
        records.groupBy(F.window(time, length).alias("w"), y.cast("int").alias("y"), x.cast("int").alias("x"))
        .agg(F.sum(value).alias(value))
        .select(F.col("w.start").alias("ts"), "y", "x", value)
    )


def write_updates(
    records: DataFrame, time: str, length: str, y: Column, x: Column, value: str, path: str, checkpoint: str
) -> None:
    """Run the stream over what is available; each batch adds its sums under ``path``."""

    def add(batch: DataFrame, batch_id: int) -> None:
        sums = pixel_windows(batch, time, length, y, x, value)
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
    )
    query.awaitTermination()


def totals(updates: DataFrame, value: str) -> DataFrame:
    """The sum of each pixel over all batches."""
    return updates.groupBy("ts", "y", "x").agg(F.sum(value).alias(value))
