"""Track numbers on a stream of labelled frames.

Each micro-batch is numbered by the same joins as a whole table, from the frame
that the batch before ended with onwards, so a batch costs what its own frames
cost.  What is carried from batch to batch is one frame: its labels, its points
as far as they are known, and the highest track number given out.  A point is
settled once the frame after it is complete, and settled points never change.

Every batch writes into folders named by its number and reads only those of the
batch before; the head row, written last, commits it.  A batch that is repeated
after a failure therefore replaces itself.

Rows: frame_id, epoch_s, y, x, feature_id.  Frame numbers follow time.  A frame
may come in several batches; it is complete when a later frame is seen.  A frame
without features is announced by a row whose feature_id is NULL.  Rows of a frame
that is already settled raise an error instead of being lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from driftfield.operators import link, tracks
from driftfield.workspace import Workspace

ROWS = "frame_id long, epoch_s long, y int, x int, feature_id long"
POINTS = (
    "frame_id long, feature_id long, track_id long, track_status int, merge_track long, split_track long, track_reset int"
)
HEAD = "frame_id long, numbered boolean, last_id long"
CLOSED = 2


def _typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in (c.split() for c in schema.split(", "))])


@dataclass
class Extension:
    """Points up to a frame: settled ones, those of the frame itself, and what the next step has to know."""

    settled: DataFrame
    open: DataFrame
    head: Row


class TrackStream:
    """Numbering of one domain's frames below ``folder``, which driver and executors share."""

    def __init__(self, ws: Workspace, folder: str, othresh: float, timegap_h: float):
        self.ws = ws
        self.spark = ws.spark
        self.folder = folder.rstrip("/")
        self.othresh = othresh
        self.timegap_h = timegap_h

    def run(self, rows: DataFrame, checkpoint: str) -> None:
        """Take in whatever the stream ``rows`` has that was not taken in yet."""
        query = (
            rows.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(self.advance)
            .start()
        )
        query.awaitTermination()

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: settle the frames that became complete, carry the last one."""
        head, kept, held = self._state(batch_id - 1)
        # read back in the session of the workspace, which plans adaptively (a stream's own session does not)
        fresh = self.ws.write(_typed(batch, ROWS), "stream_rows")
        earliest = fresh.agg(F.min("frame_id")).first()[0]
        if earliest is not None and head.frame_id is not None and earliest <= head.frame_id:
            raise ValueError(f"rows of frame {earliest} came after frame {head.frame_id} was complete")
        rows = kept.unionByName(fresh)
        newest = rows.agg(F.max("frame_id")).first()[0]
        last = None if newest is None else rows.where(F.col("frame_id") < newest).agg(F.max("frame_id")).first()[0]
        step = self._extend(rows, held, head, last)
        later = rows if last is None else rows.where(F.col("frame_id") >= last)
        for name, table in (("points", step.settled), ("rows", later), ("open", step.open)):
            table.write.mode("overwrite").parquet(self._path(name, batch_id))
        self.spark.createDataFrame([step.head], HEAD).coalesce(1).write.mode("overwrite").parquet(self._path("head", batch_id))
        for name in ("rows", "open", "head"):
            self._delete(self._path(name, batch_id - 2))

    def points(self) -> DataFrame:
        """Track points of all frames so far, as if the newest were the last one there is."""
        if not self._exists(f"{self.folder}/head"):
            return self.spark.createDataFrame([], POINTS)
        batch_id = self.spark.read.schema(f"{HEAD}, batch long").parquet(f"{self.folder}/head").agg(F.max("batch")).first()[0]
        head, rows, held = self._state(batch_id)
        step = self._extend(rows, held, head, rows.agg(F.max("frame_id")).first()[0])
        settled = (
            self.spark.read.schema(f"{POINTS}, batch long")
            .parquet(f"{self.folder}/points")
            .where(F.col("batch") <= batch_id)
            .drop("batch")
        )
        return settled.unionByName(step.settled).unionByName(step.open.withColumn("track_reset", F.lit(CLOSED)))

    def _extend(self, rows: DataFrame, held: DataFrame, head: Row, last: int | None) -> Extension:
        """Number the frames from ``head.frame_id`` to ``last``."""
        first = head.frame_id
        if last is None or last == first:
            return Extension(held.limit(0), held, head)
        ws = self.ws
        seen = rows.where(F.col("frame_id") <= last)
        frames = seen.groupBy("frame_id").agg(F.min("epoch_s").alias("epoch_s"))
        labels = seen.where("feature_id is not null").select("frame_id", "y", "x", "feature_id")
        features = ws.write(labels.groupBy("frame_id", "feature_id").agg(F.count(F.lit(1)).alias("npix")), "features")
        pairs = ws.write(link.frame_pairs(frames, self.timegap_h), "pairs")
        links = ws.write(link.overlap_links(labels, pairs, self.othresh, features=features), "links")
        local = ws.write(
            _typed(tracks.number_tracks(features, links, pairs, ws, self.othresh), POINTS), "local_points"
        )
        # the first frame's features come first in the local numbering; those that had a number keep it
        at_first = local.where(F.col("frame_id") == F.lit(first))
        known = ws.write(
            at_first.select("feature_id", F.col("track_id").alias("local_id"))
            .join(held.select("feature_id", "track_id"), "feature_id")
            .select("local_id", F.col("track_id").alias("known_id")),
            "known_ids",
        )
        moved = ws.write(_renumbered(local, known, head.last_id - known.count()), "moved_points")

        settled = moved.where(F.col("frame_id") < last)
        if head.numbered:
            settled = settled.where(F.col("frame_id") > first).unionByName(
                _continued(held, moved.where(F.col("frame_id") == first))
            )
        before = moved.where(F.col("frame_id") == last - 1).select("track_id", F.lit(True).alias("_older")).distinct()
        newborn = F.when(F.col("_older").isNull(), 0)
        opened = (
            moved.where(F.col("frame_id") == last)
            .join(before, "track_id", "left")
            .withColumn("track_reset", newborn.cast("int"))
        )
        row = moved.agg(F.max("track_id")).first()
        reached = pairs.where(F.col("next_frame") == last)
        return Extension(
            _typed(settled, POINTS),
            _typed(opened, POINTS),
            Row(frame_id=last, numbered=not reached.isEmpty(), last_id=max(head.last_id, row[0] or 0)),
        )

    def _state(self, batch_id: int) -> tuple[Row, DataFrame, DataFrame]:
        if batch_id < 0:
            nothing = Row(frame_id=None, numbered=False, last_id=0)
            return nothing, self.spark.createDataFrame([], ROWS), self.spark.createDataFrame([], POINTS)
        return (
            self.spark.read.schema(HEAD).parquet(self._path("head", batch_id)).first(),
            self.spark.read.schema(ROWS).parquet(self._path("rows", batch_id)),
            self.spark.read.schema(POINTS).parquet(self._path("open", batch_id)),
        )

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.folder}/{name}/batch={batch_id}"

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _renumbered(points: DataFrame, known: DataFrame, shift: int) -> DataFrame:
    """``points`` with known ids in place of local ones and all other ids moved by ``shift``."""
    out = points
    for col in ("track_id", "merge_track", "split_track"):
        # rows without a pointer get a key of their own, so they do not pile up on NULL
        key = F.coalesce(col, -F.col("feature_id") - 1)
        out = (
            out.withColumn("local_id", key)
            .join(known, "local_id", "left")
            .withColumn(col, F.coalesce("known_id", F.col(col) + shift))
            .drop("local_id", "known_id")
        )
    return out


def _continued(held: DataFrame, onward: DataFrame) -> DataFrame:
    """Points of the carried frame: what the frame before gave them and what the frame after adds.

    Without a frame after it (``onward`` is empty) the carried frame ends its run.
    """
    after = onward.select(
        "feature_id", F.col("track_status").alias("_status"), F.col("merge_track").alias("_merge")
    )
    return held.join(after, "feature_id", "left").select(
        "frame_id", "feature_id", "track_id",
        (F.col("track_status") + F.coalesce("_status", F.lit(0))).alias("track_status"),
        F.col("_merge").alias("merge_track"),
        "split_track",
        F.when(F.col("_status").isNull(), CLOSED).otherwise(F.col("track_reset")).alias("track_reset"),
    )
