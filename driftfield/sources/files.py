"""Frame files: time from the file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.functions.timeparse import name_time


def list_frames(spark: SparkSession, path: str, base: str, pattern: str, start=None, end=None) -> DataFrame:
    """(path, ts) of the files named ``base`` + time, within an inclusive time range."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"{base}*").load(path).select("path")
    )
    timed = files.withColumn("ts", name_time("path", base, pattern))
    return timed if start is None else timed.where(F.col("ts").between(start, end))
