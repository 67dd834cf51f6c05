"""Numbering a stream of frames gives the rows of numbering them all at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftfield.operators import label, link, tracks
from driftfield.streaming.tracking import ROWS, TrackStream

OTHRESH, GAP_H = 0.3, 1.5
COLUMNS = ["frame_id", "feature_id", "track_id", "track_status", "merge_track", "split_track", "track_reset"]


@pytest.fixture(scope="module")
def moving(spark, ws):
    """Nine frames of drifting blobs with a gap in time after the fourth and no feature in the seventh."""
    rng = np.random.default_rng(3)
    base, rows, hours = rng.random((12, 12)), [], []
    for f in range(1, 10):
        base = 0.7 * np.roll(base, 1, axis=1) + 0.3 * rng.random((12, 12))
        hours.append(f if f < 5 else f + 8)
        if f != 7:
            rows += [(f, int(y), int(x)) for y, x in zip(*np.nonzero(base > np.quantile(base, 0.6)))]
    px = spark.createDataFrame(rows, "frame_id long, y int, x int")
    regions = ws.write(label.label_regions(px, ws, tile=5), "regions")
    labels = label.renumber(regions, ws.write(label.rank_regions(regions, 0), "features"))
    pdf = labels.select("frame_id", "y", "x", "feature_id").toPandas()
    pdf = pd.concat([pdf, pd.DataFrame([{"frame_id": 7}])], ignore_index=True)
    pdf["epoch_s"] = [hours[f - 1] * 3600 for f in pdf.frame_id]
    return pdf.astype({c: "Int64" for c in pdf.columns})


def frame(spark, pdf):
    rows = [tuple(None if pd.isna(v) else int(v) for v in r) for r in pdf[[c.split()[0] for c in ROWS.split(", ")]].values]
    return spark.createDataFrame(rows, ROWS)


def normal(df):
    pdf = df.select(*[F.col(c).cast("long").alias(c) for c in COLUMNS]).toPandas().astype("Int64")
    return pdf.sort_values(COLUMNS[:2]).reset_index(drop=True)


def at_once(spark, ws, pdf):
    rows = frame(spark, pdf)
    labels = ws.write(rows.where("feature_id is not null"), "labels")
    pairs = link.frame_pairs(rows.select("frame_id", "epoch_s").distinct(), GAP_H)
    features = labels.groupBy("frame_id", "feature_id").agg(F.count(F.lit(1)).alias("npix"))
    links = ws.write(link.overlap_links(labels, pairs, OTHRESH), "links")
    return normal(tracks.number_tracks(features, links, pairs, ws, OTHRESH))


@pytest.mark.parametrize("cuts", [(3, 6), (4, 7)])
def test_batches_give_the_rows_of_the_whole(spark, ws, moving, cuts):
    stream = TrackStream(ws, ws.folder("stream"), OTHRESH, GAP_H)
    low = 0
    for n, high in enumerate((*cuts, 9)):
        stream.advance(frame(spark, moving[(moving.frame_id > low) & (moving.frame_id <= high)]), n)
        low = high
        if n:
            pd.testing.assert_frame_equal(normal(stream.points()), at_once(spark, ws, moving[moving.frame_id <= high]))


def test_files_restart_and_a_frame_in_two_batches(spark, ws, moving):
    source, base = ws.folder("files"), ws.folder("numbered")
    order = moving.sort_values(["frame_id", "y", "x"])
    fifth = order[order.frame_id == 5]
    parts = [
        order[order.frame_id < 4],
        pd.concat([order[order.frame_id == 4], fifth[: len(fifth) // 2]]),
        pd.concat([fifth[len(fifth) // 2 :], order[order.frame_id == 6]]),
        order[order.frame_id > 6],
    ]

    def take_in():
        rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        TrackStream(ws, base, OTHRESH, GAP_H).run(rows, f"{base}/offsets")

    for part in parts[:2]:
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    take_in()
    for part in parts[2:]:
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    take_in()
    take_in()
    got = TrackStream(ws, base, OTHRESH, GAP_H).points()
    pd.testing.assert_frame_equal(normal(got), at_once(spark, ws, moving))


def test_a_repeated_batch_replaces_itself(spark, ws, moving):
    stream = TrackStream(ws, ws.folder("stream"), OTHRESH, GAP_H)
    stream.advance(frame(spark, moving[moving.frame_id <= 4]), 0)
    for _ in range(2):
        stream.advance(frame(spark, moving[moving.frame_id.isin([5, 6])]), 1)
    pd.testing.assert_frame_equal(normal(stream.points()), at_once(spark, ws, moving[moving.frame_id <= 6]))


def test_late_rows_are_an_error(spark, ws, moving):
    stream = TrackStream(ws, ws.folder("stream"), OTHRESH, GAP_H)
    stream.advance(frame(spark, moving[moving.frame_id <= 4]), 0)
    with pytest.raises(ValueError, match="frame 2 came after"):
        stream.advance(frame(spark, moving[moving.frame_id == 2]), 1)


def test_nothing_yet_and_an_empty_batch(spark, ws, moving):
    stream = TrackStream(ws, ws.folder("stream"), OTHRESH, GAP_H)
    assert stream.points().count() == 0
    stream.advance(frame(spark, moving[moving.frame_id < 0]), 0)
    assert stream.points().count() == 0
    stream.advance(frame(spark, moving[moving.frame_id <= 3]), 1)
    pd.testing.assert_frame_equal(normal(stream.points()), at_once(spark, ws, moving[moving.frame_id <= 3]))
