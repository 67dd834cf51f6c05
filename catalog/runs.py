"""Whole plans from options, exports and the streaming source."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as sql
from catalog.radar import volume
from catalog.registry import query
from catalog.stages import MIN_NPIX, NX, NY, OTHRESH, PIXEL_KM, TIMEGAP_H, Stages, rounded
from catalog.statistics import POINT
from driftfield.functions import geo
from driftfield.operators import mapback
from driftfield.options import CellOptions, ConvectiveOptions, GenericOptions
from driftfield.plans import cells, convective, generic
from driftfield.sources import sinks
from driftfield.streaming import frames as stream
from driftfield.streaming.tracking import ROWS, TrackStream

COMMON = dict(shape=(NY, NX), timegap_h=TIMEGAP_H, pixel_km=PIXEL_KM)


def _frames(st: Stages):
    return st.frames().select("frame_id", "epoch_s")


@query("run_generic_tracking", sql.query("series", f"SELECT {POINT}, {sql.rnd('area meanlat meanlon')} FROM series"))
def run_generic_tracking(spark, sf):
    st = Stages(spark, sf)
    field = st.field().select("frame_id", "y", "x", (F.lit(241.0) - F.col("tb")).alias("value"))
    opt = GenericOptions.from_config(
        {**COMMON, "field_thresh": [0.0, 1e9], "min_npix": MIN_NPIX, "othresh": OTHRESH, "main_hours": 3.0}
    )
    result = st.keep("run_generic", lambda: generic.run_generic(field, st.grid(), _frames(st), st.ws, opt).tracks.series)
    return rounded(result)


@query("run_convective_tracking")
def run_convective_tracking(spark, sf):
    st = Stages(spark, sf)
    opt = ConvectiveOptions(
        **COMMON, othresh=OTHRESH, cloud_area=200.0, min_core_npix=0, smooth_size=3, system_area=400.0, system_hours=3.0,
        rain_min=3.0, rain_heavy=6.0, rain_area=100.0, axis_min=15.0, rain_hours=2.0, coef_area=(300.0, 10.0),
        coef_rate=(3.0, 0.1), coef_skew=(-1.0, 0.01), coef_heavy=(3.0, 0.4), motion_npix=3, max_speed=8.0,
    )
    field = st.field().select("frame_id", "y", "x", "tb", "rain")
    return rounded(
        st.keep(
            "run_convective",
            lambda: convective.run_convective(field, st.grid(), _frames(st), st.ws, opt).movement,
        )
    )


@query("run_cell_tracking")
def run_cell_tracking(spark, sf):
    st = Stages(spark, sf)
    opt = CellOptions(
        **COMMON, othresh=OTHRESH, dx_m=1000.0, dy_m=1000.0, bkg_radius_m=3000.0, min_diff=10.0, abs_thresh=42.0,
        core_dbz=46.0, weak_dbz=20.0, min_core_km2=2.0, expand_km=(1.0, 2.0), steps=dict(max_radius=2), echo_tops=(20, 30, 40),
    )
    grid = st.grid().select(
        "y", "x", "lat", "lon", "area_km2",
        geo.semi_symmetric("x", NX).cast("double").alias("x_km"), geo.semi_symmetric("y", NY).cast("double").alias("y_km"),
    ).withColumn("range_ok", geo.range_mask("x_km", "y_km", 8))
    return rounded(
        st.keep(
            "run_cells",
            lambda: cells.run_cells(volume(st).drop("d"), grid, _frames(st), st.ws, opt).tracks.series,
        )
    )


@query("run_cell_pixels")
def run_cell_pixels(spark, sf):
    """The cell run with advection: pixels with the track numbers of their cells."""
    st = Stages(spark, sf)
    opt = CellOptions(
        **COMMON, othresh=OTHRESH, dx_m=1000.0, dy_m=1000.0, bkg_radius_m=3000.0, min_diff=10.0, abs_thresh=42.0,
        core_dbz=46.0, weak_dbz=20.0, min_core_km2=2.0, expand_km=(1.0, 2.0), steps=dict(max_radius=2),
        echo_tops=(20, 30, 40), advection=True, advect_dbz=25.0,
    )
    grid = st.grid().select(
        "y", "x", "lat", "lon", "area_km2",
        geo.semi_symmetric("x", NX).cast("double").alias("x_km"), geo.semi_symmetric("y", NY).cast("double").alias("y_km"),
    ).withColumn("range_ok", geo.range_mask("x_km", "y_km", 8))
    return st.keep(
        "run_cell_pixels", lambda: cells.run_cells(volume(st).drop("d"), grid, _frames(st), st.ws, opt).pixels
    )


@query("run_convective_linked")
def run_convective_linked(spark, sf):
    """The cloud and rain run with clouds linked by their rain: the track series."""
    st = Stages(spark, sf)
    opt = ConvectiveOptions(
        **COMMON, othresh=OTHRESH, cloud_area=200.0, min_core_npix=0, smooth_size=3, system_area=400.0, system_hours=3.0,
        rain_min=3.0, rain_heavy=6.0, rain_area=100.0, link_rain=True, link_rain_min=4.0,
    )
    field = st.field().select("frame_id", "y", "x", "tb", "rain")
    return rounded(
        st.keep("run_linked", lambda: convective.run_convective(field, st.grid(), _frames(st), st.ws, opt).tracks.series)
    )


@query("mask_export", sql.query("pixel_tracks", """
SELECT frame_id, y, x, cloudtracknumber AS mcs_mask, cloudmerge_tracknumber AS merge_mask, cloudsplit_tracknumber AS split_mask FROM pixel_tracks"""))
def mask_export(spark, sf):
    st = Stages(spark, sf)
    return sinks.mask_table(mapback.map_tracks(st.labels(), st.assignment()))


@query("masks_by_day", sql.query(("pixel_tracks", "frames"), """
SELECT CAST(t.ts AS DATE) AS date, frame_id, y, x, cloudtracknumber FROM pixel_tracks JOIN frames t USING (frame_id)"""))
def masks_by_day(spark, sf):
    """Pixel masks written by day and read back."""
    st = Stages(spark, sf)
    path = st.ws.folder("masks")
    mapped = mapback.map_tracks(st.labels(), st.assignment()).select("frame_id", "y", "x", "cloudtracknumber")
    sinks.write_by_day(mapped, st.frames(), path)
    return spark.read.parquet(path).select("date", "frame_id", "y", "x", "cloudtracknumber")


@query("stage_tables_written", sql.query(("points", "links"), """
SELECT 'points' AS kind, frame_id, feature_id AS id, track_id AS value FROM points
UNION ALL SELECT 'links', ref_frame, ref_id, overlap_px FROM links"""))
def stage_tables_written(spark, sf):
    """Track numbers and links written as tables and read back."""
    st = Stages(spark, sf)
    path = st.ws.folder("tables")
    sinks.write_tables({"points": st.points(), "links": st.links()}, path)
    points = spark.read.parquet(f"{path}/points").select(
        F.lit("points").alias("kind"), "frame_id", F.col("feature_id").cast("long").alias("id"), F.col("track_id").alias("value")
    )
    links = spark.read.parquet(f"{path}/links").select(
        F.lit("links").alias("kind"), F.col("ref_frame").alias("frame_id"), F.col("ref_id").cast("long").alias("id"), F.col("overlap_px").alias("value")
    )
    return points.unionByName(links)


@query("streamed_frames", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, CAST((user_id // 16) % 16 AS INTEGER) AS y, CAST(user_id % 16 AS INTEGER) AS x,
       round(sum(value), 6) AS value FROM events GROUP BY 1, 2, 3""")
def streamed_frames(spark, sf):
    st = Stages(spark, sf)

    def build():
        records = (
            spark.readStream.schema(st.table("events").schema)
            .option("pathGlobFilter", "events.parquet")
            .parquet(sf)
            .select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
        )
        u = F.col("user_id")
        path = st.ws.folder("stream")
        stream.write_updates(
            records, "ts", "1 day", F.floor(u / 16) % 16, u % 16, "value", f"{path}/updates", f"{path}/offsets"
        )
        return stream.totals(spark.read.parquet(f"{path}/updates"), "value")

    return rounded(st.keep("streamed", build), 6)


@query("streamed_tracks", sql.query("points", "SELECT * FROM points"))
def streamed_tracks(spark, sf):
    """Track points from a stream of labelled frames that arrive in three parts, with a restart before each."""
    st = Stages(spark, sf)

    def build():
        base = st.ws.folder("numbered")
        source = f"{base}/frames"
        frames = st.frames().select("frame_id", "epoch_s")
        # a frame without features still has its row
        rows = frames.join(st.labels().select("frame_id", "y", "x", "feature_id"), "frame_id", "left").select(
            *[F.col(c.split()[0]).cast(c.split()[1]) for c in ROWS.split(", ")]
        )
        ends = frames.agg(F.min("frame_id").alias("low"), F.max("frame_id").alias("high")).first()
        part = F.floor((F.col("frame_id") - ends.low) * 3 / (ends.high - ends.low + 1))
        numbered = TrackStream(st.ws, f"{base}/tracks", OTHRESH, TIMEGAP_H)
        for n in range(3):
            rows.where(part == n).write.mode("append").parquet(source)
            numbered.run(spark.readStream.schema(ROWS).parquet(source), f"{base}/offsets")
        return numbered.points().withColumn("feature_id", F.col("feature_id").cast("int"))

    return st.keep("streamed_tracks", build)
