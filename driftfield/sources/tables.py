"""Gridded frames from tabular sources.

A frame is any time bucket, a pixel any integer (y, x) address; several source
rows of one pixel are summed with map-side partial aggregation, so a hot pixel
or a hot frame never meets in one task before it has shrunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.operators.ranking import frame_index


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_frames(
    rows: DataFrame, time: Column, y: Column, x: Column, values: dict[str, Column]
) -> DataFrame:
    """(ts, y, x, values...) with one row per pixel; ``values`` are aggregates."""
    return (
        rows.select(time.alias("ts"), y.cast("int").alias("y"), x.cast("int").alias("x"), "*")
        .groupBy("ts", "y", "x")
        .agg(*[expr.alias(name) for name, expr in values.items()])
    )


def lingering_times(times: DataFrame, steps: int, unit: str = "month") -> DataFrame:
    """Each ``ts`` and the following ``steps - 1`` ones (months or weeks)."""
    copies = times.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    if unit == "month":
        moved = F.add_months("ts", F.col("_k")).cast("timestamp")
    else:
        moved = F.col("ts") + F.make_dt_interval(F.col("_k") * 7)
    return copies.withColumn("ts", moved).drop("_k")


def lingering(pixels: DataFrame, steps: int, unit: str = "month") -> DataFrame:
    """Add each pixel sum to the following steps as well (a moving sum).

    Runs on the already aggregated pixels, so the copies are pixel-sized.
    """
    values = [c for c in pixels.columns if c not in ("ts", "y", "x")]
    copies = lingering_times(pixels, steps, unit)
    return copies.groupBy("ts", "y", "x").agg(*[F.sum(v).alias(v) for v in values])


def frame_table(times: DataFrame, step_s: int | None = None) -> DataFrame:
    """(frame_id, ts, epoch_s) of all distinct ``ts``; with ``step_s`` on an even clock."""
    frames = frame_index(times)
    epoch = F.col("frame_id") * step_s if step_s else F.unix_timestamp("ts")
    return frames.select("frame_id", "ts", epoch.cast("long").alias("epoch_s"))


def standardised(pixels: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add deviations from the frame mean in standard deviations (value column -> new column).

    The moments of all columns come from one aggregation to a frame-sized table,
    joined back by frame.
    """
    moments = pixels.groupBy("frame_id").agg(
        *[F.avg(v).alias(f"_m_{v}") for v in columns], *[F.stddev_pop(v).alias(f"_s_{v}") for v in columns]
    )
    out = pixels.join(moments, "frame_id")
    return out.withColumns(
        {
            z: F.when(F.col(f"_s_{v}") > 0, (F.col(v) - F.col(f"_m_{v}")) / F.col(f"_s_{v}")).otherwise(0.0)
            for v, z in columns.items()
        }
    ).drop(*[f"_{k}_{v}" for v in columns for k in "ms"])
