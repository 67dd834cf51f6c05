"""Rain inside systems: totals, rain features, robust systems and life cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as sql
from catalog.registry import query
from catalog.stages import DT_H, Stages, rounded
from driftfield.operators import precip, systems

TOTALS = "total_rain total_volrain total_heavyrain total_heavyvolrain rainrate_heavyrain rainrate_p95 pf_landfrac"
SHAPES = (
    "pf_lon pf_lat pf_area pf_rainrate pf_maxrainrate pf_accumrain pf_accumrainheavy pf_skewness pf_majoraxis "
    "pf_minoraxis pf_aspectratio pf_eccentricity pf_orientation pf_perimeter pf_lat_maxrainrate pf_lon_maxrainrate"
)


@query("system_rain_totals", sql.query("rain_totals", f"SELECT track_id, frame_id, time_idx, {sql.rnd(TOTALS)} FROM rain_totals"))
def system_rain_totals(spark, sf):
    return rounded(Stages(spark, sf).rain_totals())


@query("rain_features", sql.query("rain_features", f"SELECT track_id, frame_id, time_idx, pf_rank, pf_npix, {sql.rnd(SHAPES, pf_skewness=6, pf_eccentricity=6, pf_orientation=6)} FROM rain_features"))
def rain_features(spark, sf):
    feats, _ = Stages(spark, sf).rain_features()
    return rounded(feats.drop("_cy", "_cx", "_hy", "_hx"), pf_skewness=6, pf_eccentricity=6, pf_orientation=6)


@query("rain_feature_centroids", sql.query(("rain_features", "grid"), """
SELECT f.track_id, f.frame_id, f.pf_rank, c.lat AS pf_lat_centroid, c.lon AS pf_lon_centroid,
       w.lat AS pf_lat_weightedcentroid, w.lon AS pf_lon_weightedcentroid
FROM rain_features f LEFT JOIN grid c ON c.y = f.cy AND c.x = f.cx LEFT JOIN grid w ON w.y = f.hy AND w.x = f.hx"""))
def rain_feature_centroids(spark, sf):
    st = Stages(spark, sf)
    feats, _ = st.rain_features()
    placed = precip.place_centroids(feats, st.grid())
    return placed.select(
        "track_id", "frame_id", "pf_rank", "pf_lat_centroid", "pf_lon_centroid",
        "pf_lat_weightedcentroid", "pf_lon_weightedcentroid",
    )


@query("rain_feature_counts", sql.query("rain_features", "SELECT * FROM pf_counts"))
def rain_feature_counts(spark, sf):
    return Stages(spark, sf).rain_features()[1]


sql.fragment("pf_series", ("rain_features", "rain_totals"), """
pf_series AS MATERIALIZED (
  SELECT t.track_id, t.time_idx, t.total_volrain, t.total_heavyvolrain, f.pf_majoraxis, f.pf_area, f.pf_rainrate,
         f.pf_skewness, f.pf_maxrainrate
  FROM rain_totals t LEFT JOIN rain_features f ON f.track_id = t.track_id AND f.time_idx = t.time_idx AND f.pf_rank = 1),
pf_cand AS (
  SELECT *, sum(opens) OVER (PARTITION BY track_id ORDER BY time_idx) AS island
  FROM (SELECT *, CASE WHEN time_idx - lag(time_idx) OVER w > 1 THEN 1 ELSE 0 END AS opens,
               count(*) OVER (PARTITION BY track_id) AS n
        FROM pf_series WHERE pf_majoraxis BETWEEN 15 AND 1800 WINDOW w AS (PARTITION BY track_id ORDER BY time_idx))
  WHERE n > 2),
pf_period AS MATERIALIZED (
  SELECT *, (max(time_idx) OVER i - min(time_idx) OVER i + 1) * 1.0::DOUBLE AS period_h
  FROM pf_cand WINDOW i AS (PARTITION BY track_id, island))
""")


def _pf_series(st: Stages):
    feats, _ = st.rain_features()
    largest = feats.where("pf_rank = 1").select(
        "track_id", "time_idx", "pf_majoraxis", "pf_area", "pf_rainrate", "pf_skewness", "pf_maxrainrate"
    )
    return st.rain_totals().join(largest, ["track_id", "time_idx"], "left")


@query("robust_by_rain", sql.query("pf_series", """
SELECT track_id, time_idx, period_h FROM (
  SELECT *, count(*) FILTER (pf_area > 300 + 10 * period_h AND pf_rainrate > 3 + 0.1 * period_h AND pf_skewness > -1 + 0.01 * period_h) OVER i AS strong,
         100.0 * sum(total_heavyvolrain) OVER i / sum(total_volrain) OVER i AS ratio
  FROM pf_period WHERE period_h >= 2 WINDOW i AS (PARTITION BY track_id, island))
WHERE strong >= 2 AND ratio > 3 + 0.4 * period_h"""))
def robust_by_rain(spark, sf):
    return systems.robust_by_rain(
        _pf_series(Stages(spark, sf)), (15, 1800), 2, 1, DT_H, (300, 10), (3, 0.1), (-1, 0.01), (3, 0.4)
    )


@query("robust_by_volume", sql.query("pf_series", """
SELECT track_id, time_idx, period_h FROM (
  SELECT *, count(*) FILTER (pf_maxrainrate > 6) OVER i AS peak, count(*) FILTER (total_volrain > 1500) OVER i AS vol
  FROM pf_period WHERE period_h >= 2 WINDOW i AS (PARTITION BY track_id, island))
WHERE peak >= 2 AND vol >= 2"""))
def robust_by_volume(spark, sf):
    return systems.robust_by_volume(_pf_series(Stages(spark, sf)), (15, 1800), 2, 1, DT_H, 6.0, 1500.0, 2)


@query("rain_feature_lifetime", sql.query("rain_features", """
SELECT track_id, CAST(count(*) FILTER (a > 20) AS DOUBLE) AS pf_lifetime
FROM (SELECT track_id, time_idx, max(pf_majoraxis) AS a FROM rain_features GROUP BY 1, 2) GROUP BY 1"""))
def rain_feature_lifetime(spark, sf):
    return systems.feature_lifetime(Stages(spark, sf).rain_features()[0], 20.0, DT_H)
