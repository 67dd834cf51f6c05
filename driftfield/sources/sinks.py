"""Writing stage tables for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_day(df: DataFrame, frames: DataFrame, path: str, rows_per_file: int = 4_000_000) -> None:
    """Parquet partitioned by day.

    The shuffle is by day and frame, so one busy day is still written by many tasks.
    """
    dated = df.join(frames.select("frame_id", F.to_date("ts").alias("date")), "frame_id")
    (
        dated.repartition("date", "frame_id")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("date")
        .parquet(path)
    )


# fixed values: column names of the mask export presets
MASK_PRESETS = {
    "mask": {
        "cloudtracknumber": "mcs_mask", "pcptracknumber": "mcs_rain_mask",
        "cloudmerge_tracknumber": "merge_mask", "cloudsplit_tracknumber": "split_mask",
    },
    "full": {},
}


def mask_table(pixel_tracks: DataFrame, preset: str = "mask", rename: dict[str, str] | None = None) -> DataFrame:
    """Pixel masks with export names; a preset with names keeps only those columns."""
    names = {**MASK_PRESETS[preset], **(rename or {})}
    present = {k: v for k, v in names.items() if k in pixel_tracks.columns}
    if MASK_PRESETS[preset]:
        return pixel_tracks.select("frame_id", "y", "x", *[F.col(k).alias(v) for k, v in present.items()])
    return pixel_tracks.withColumnsRenamed(present)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
