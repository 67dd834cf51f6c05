"""Track statistics, systems, attachments and the map back to pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as sql
from catalog.registry import query
from catalog.stages import DT_H, STEP_S, Stages, rounded
from driftfield.operators import mapback, stats, systems

STATS = "area meanlat meanlon core_area cold_area corecold_mintb corecold_meantb core_meantb mintb_lat mintb_lon"
POINT = "frame_id, cloudnumber, track_id, track_status, merge_track, split_track, track_reset, npix, base_time, time_idx"


@query("feature_stats_tb", sql.query("feature_stats", f"SELECT frame_id, feature_id, npix, {sql.rnd(STATS)} FROM feature_stats"))
def feature_stats_tb(spark, sf):
    return rounded(Stages(spark, sf).feature_stats())


@query("track_series", sql.query("all_series", f"SELECT {POINT}, {sql.rnd(STATS)} FROM all_series"))
def track_series(spark, sf):
    return rounded(Stages(spark, sf).all_series())


@query("track_start_end", sql.query("all_ends", "SELECT * FROM all_ends"))
def track_start_end(spark, sf):
    return stats.track_ends(Stages(spark, sf).all_series())


@query("remove_short_tracks", sql.query("series", f"SELECT {POINT}, {sql.rnd(STATS)} FROM series"))
def remove_short_tracks(spark, sf):
    return rounded(Stages(spark, sf).series())


@query("track_attributes", sql.query("ends", "SELECT * FROM ends"))
def track_attributes(spark, sf):
    return Stages(spark, sf).ends()


@query("identify_systems", sql.query("systems", "SELECT * FROM systems"))
def identify_systems(spark, sf):
    return Stages(spark, sf).systems()


@query("system_series", sql.query("system_series", f"SELECT {POINT}, mcs_duration, mcs_status, {sql.rnd(STATS + ' ccs_area')} FROM system_series"))
def system_series(spark, sf):
    return rounded(Stages(spark, sf).system_series())


ATTACHED = f"SELECT track_id, time_idx, base_time, kind, slot, part_track, cloudnumber, part_status, {sql.rnd('part_area')}"


@query("attach_merge_split", sql.query("attached", f"{ATTACHED} FROM attached"))
def attach_merge_split(spark, sf):
    return rounded(Stages(spark, sf).attached())


MAIN = """
main AS MATERIALIZED (
  SELECT e.track_id, e.track_duration, m.max_area
  FROM (SELECT track_id, max(area) AS max_area FROM series GROUP BY 1 HAVING max(area) >= 700) m
  JOIN ends e USING (track_id) WHERE e.track_duration >= 3)
"""
sql.fragment("main", ("ends",), MAIN)
sql.fragment("main_attached", ("main",), sql.attached_sql("main_attached", "main", "p.area"))


@query("main_tracks", sql.query("main", f"SELECT track_id, track_duration, {sql.rnd('max_area')} FROM main"))
def main_tracks(spark, sf):
    st = Stages(spark, sf)
    return rounded(systems.main_tracks(st.series(), st.ends(), 3, 700.0, DT_H))


@query("link_merge_split_main", sql.query("main_attached", f"{ATTACHED} FROM main_attached"))
def link_merge_split_main(spark, sf):
    st = Stages(spark, sf)
    main = systems.main_tracks(st.series(), st.ends(), 3, 700.0, DT_H)
    return rounded(systems.attachments(st.series(), st.ends(), main, 12, 12, DT_H, F.col("area")))


sql.fragment("assignment", ("system_series", "attached"), """
claims AS (
  SELECT frame_id, cloudnumber AS feature_id, track_id, track_status, merge_track, split_track, 'own' AS kind FROM system_series
  UNION ALL
  SELECT s.frame_id, a.cloudnumber, a.track_id, NULL, NULL, NULL, a.kind
  FROM attached a JOIN system_series s USING (track_id, time_idx)),
assignment AS MATERIALIZED (
  SELECT frame_id, feature_id, max(track_id) FILTER (kind = 'own') AS tracknumber,
         arg_max(track_status, track_id) FILTER (kind = 'own') AS track_status,
         arg_max(merge_track, track_id) FILTER (kind = 'own') AS merge_tracknumber,
         arg_max(split_track, track_id) FILTER (kind = 'own') AS split_tracknumber,
         max(track_id) AS cloudtracknumber,
         max(track_id) FILTER (kind = 'merge') AS cloudmerge_tracknumber,
         max(track_id) FILTER (kind = 'split') AS cloudsplit_tracknumber
  FROM claims GROUP BY 1, 2)
""")

sql.fragment("pixel_tracks", ("assignment", "labels"), """
pixel_tracks AS MATERIALIZED (
  SELECT l.frame_id, l.y, l.x, l.feature_id, a.track_status, coalesce(tracknumber, 0) AS tracknumber,
         coalesce(merge_tracknumber, 0) AS merge_tracknumber, coalesce(split_tracknumber, 0) AS split_tracknumber,
         coalesce(cloudtracknumber, 0) AS cloudtracknumber,
         coalesce(cloudmerge_tracknumber, 0) AS cloudmerge_tracknumber,
         coalesce(cloudsplit_tracknumber, 0) AS cloudsplit_tracknumber
  FROM labels l LEFT JOIN assignment a USING (frame_id, feature_id))
""")


@query("map_pixels", sql.query("pixel_tracks", "SELECT * FROM pixel_tracks"))
def map_pixels(spark, sf):
    st = Stages(spark, sf)
    return mapback.map_tracks(st.labels().drop("tb", "rain"), st.assignment())


@query("map_pixels_rain", sql.query("pixel_tracks", """
SELECT p.frame_id, p.y, p.x, p.cloudtracknumber, CASE WHEN f.rain > 3 THEN p.cloudtracknumber ELSE 0 END AS pcptracknumber
FROM pixel_tracks p JOIN field f USING (frame_id, y, x)"""))
def map_pixels_rain(spark, sf):
    st = Stages(spark, sf)
    return mapback.map_tracks(st.labels(), st.assignment(), rain_min=3.0).select(
        "frame_id", "y", "x", "cloudtracknumber", "pcptracknumber"
    )


@query("time_tolerance_join", sql.query("all_series", """
SELECT s.track_id, s.time_idx, s.base_time + (s.track_id % 7) * 30 AS base_time, f.frame_id AS matched_frame
FROM all_series s JOIN frames f ON abs(s.base_time + (s.track_id % 7) * 30 - f.epoch_s) < 60"""))
def time_tolerance_join(spark, sf):
    st = Stages(spark, sf)
    late = st.all_series().select(
        "track_id", "time_idx", (F.col("base_time") + (F.col("track_id") % 7) * 30).alias("base_time")
    )
    return mapback.match_times(late, st.frames(), 60)


@query("circular_mean_position", sql.query("cloud_pixels", """
SELECT frame_id, feature_id, round(20.0 + 1.9::DOUBLE * (CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END) / (2 * pi()), 9) + 0.0::DOUBLE AS meanlon
FROM (SELECT frame_id, feature_id, atan2(avg(sin((lon - 20) / 1.9 * 2 * pi())), avg(cos((lon - 20) / 1.9 * 2 * pi()))) AS a
      FROM cloud_pixels GROUP BY 1, 2)"""))
def circular_mean_position(spark, sf):
    px = Stages(spark, sf).cloud_pixels()
    out = stats.feature_stats(px, lon_range=(20.0, 21.9)).select("frame_id", "feature_id", "meanlon")
    return rounded(out)


@query("unwrap_positions", sql.query("all_series", """
SELECT track_id, time_idx, round(meanlon + coalesce(sum(turn) OVER (PARTITION BY track_id ORDER BY time_idx), 0) * (0.2137 / 0.2), 9) + 0.0::DOUBLE AS meanlon,
       max(abs(turn)) OVER (PARTITION BY track_id) AS pbc_flag
FROM (SELECT track_id, time_idx, meanlon,
             CASE WHEN meanlon - lag(meanlon) OVER w > 0.2137 THEN -1 WHEN meanlon - lag(meanlon) OVER w < -0.2137 THEN 1 ELSE 0 END AS turn
      FROM all_series WINDOW w AS (PARTITION BY track_id ORDER BY time_idx))"""))
def unwrap_positions(spark, sf):
    rows = Stages(spark, sf).all_series().select("track_id", "time_idx", "meanlon")
    return rounded(stats.unwrap_positions(rows, {"meanlon": 0.2137}, 0.2))


@query("dense_statistics", sql.query("series", """
SELECT track_id, k AS time_idx, round(area, 6) + 0.0::DOUBLE AS area, base_time
FROM (SELECT DISTINCT track_id FROM series), (SELECT unnest(range((SELECT max(time_idx) + 1 FROM series))) AS k)
LEFT JOIN (SELECT track_id AS t, time_idx AS i, area, base_time FROM series) ON t = track_id AND i = k"""))
def dense_statistics(spark, sf):
    dense = stats.to_dense(Stages(spark, sf).series(), ["area", "base_time"])
    flat = dense.select("track_id", F.posexplode(F.arrays_zip("area", "base_time")).alias("time_idx", "s"))
    return rounded(flat.select("track_id", "time_idx", F.col("s.area").alias("area"), F.col("s.base_time").alias("base_time")))


@query("sparse_statistics", sql.query("series", "SELECT track_id, time_idx, round(area, 6) + 0.0::DOUBLE AS area, base_time FROM series"))
def sparse_statistics(spark, sf):
    dense = stats.to_dense(Stages(spark, sf).series(), ["area", "base_time"])
    return rounded(stats.to_sparse(dense, ["area", "base_time"]))


@query("maximum_features", sql.query("labels", "SELECT max(n) AS max_features FROM (SELECT frame_id, count(*) AS n FROM features GROUP BY 1)"))
def maximum_features(spark, sf):
    per_frame = Stages(spark, sf).features().groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    return per_frame.agg(F.max("n").alias("max_features"))
