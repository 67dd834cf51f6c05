"""Radar parts of systems, periodic helpers, drift matching, coordinate repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import moving, oracle as sql
from catalog.radar import cells, classified, volume
from catalog.registry import query
from catalog.stages import DT_H, NX, NY, PIXEL_KM, STEP_S, Stages, rounded
from driftfield.functions import geo, physics
from driftfield.operators import image, motion, precip, stats, systems, vertical
from driftfield.sources import drift

sql.fragment("echo_pixels", ("system_pixels", "echo", "tops"), """
echo_pixels AS MATERIALIZED (
  SELECT p.*, e.dbz_comp, e.echo_class, e.core, t.echotop20, t.echotop30
  FROM system_pixels p JOIN echo e USING (frame_id, y, x) LEFT JOIN tops t USING (frame_id, y, x))
""")


def echo_pixels(st: Stages):
    def build():
        echo = classified(st).select("frame_id", "y", "x", "dbz_comp", "echo_class", "core")
        tops = vertical.echo_tops(volume(st), "dbz", (20, 30), 2)
        return st.system_pixels().join(echo, ["frame_id", "y", "x"]).join(tops, ["frame_id", "y", "x"], "left")

    return st.keep("echo_pixels", build)


ECHO = "pf_ccarea pf_ccrainrate pf_ccrainamount pf_sfarea pf_sfrainrate pf_sfrainamount pf_cc40area pf_cc45area"
sql.fragment("echo_extras", ("echo_pixels",), """
echo_extras AS MATERIALIZED (
  SELECT track_id, frame_id, time_idx,
         coalesce(sum(area_km2) FILTER (echo_class = 4), 0) AS pf_ccarea, avg(rain) FILTER (echo_class = 4) AS pf_ccrainrate,
         sum(rain) FILTER (echo_class = 4) AS pf_ccrainamount,
         coalesce(sum(area_km2) FILTER (echo_class = 3), 0) AS pf_sfarea, avg(rain) FILTER (echo_class = 3) AS pf_sfrainrate,
         sum(rain) FILTER (echo_class = 3) AS pf_sfrainamount,
         coalesce(sum(area_km2) FILTER (dbz_comp >= 40), 0) AS pf_cc40area, coalesce(sum(area_km2) FILTER (dbz_comp >= 45), 0) AS pf_cc45area
  FROM echo_pixels GROUP BY 1, 2, 3)
""")


def extras(st: Stages):
    return st.keep(
        "echo_extras", lambda: precip.echo_extras(echo_pixels(st), ["track_id", "frame_id", "time_idx"], 4, 3, (40, 45))
    )


@query("echo_extras", sql.query("echo_extras", f"SELECT track_id, frame_id, time_idx, {sql.rnd(ECHO)} FROM echo_extras"))
def echo_extras(spark, sf):
    return rounded(extras(Stages(spark, sf)))


sql.fragment("core_features", ("echo_pixels",), """
kpx AS MATERIALIZED (SELECT *, CAST(y AS BIGINT) * 4294967296 + x AS p FROM echo_pixels WHERE core = 1),
kedge AS MATERIALIZED (
  SELECT a.track_id, a.frame_id, a.p, b.p AS q FROM kpx a JOIN kpx b USING (track_id, frame_id) WHERE abs(a.y - b.y) + abs(a.x - b.x) = 1),
kreach AS (
  SELECT track_id, frame_id, p, p AS q FROM kpx UNION
  SELECT r.track_id, r.frame_id, r.p, e.q FROM kreach r JOIN kedge e ON e.track_id = r.track_id AND e.frame_id = r.frame_id AND e.p = r.q),
kreg AS MATERIALIZED (
  SELECT k.*, m.region FROM kpx k JOIN (SELECT track_id, frame_id, p, min(q) AS region FROM kreach GROUP BY 1, 2, 3) m USING (track_id, frame_id, p)),
kmom AS (
  SELECT track_id, frame_id, region, row_number() OVER (PARTITION BY track_id, frame_id ORDER BY count(*) DESC, region DESC) AS core_rank,
         count(*) AS npix, avg(lon) AS pf_corelon, avg(lat) AS pf_corelat, sum(area_km2) AS pf_corearea,
         max(echotop20) AS pf_coremaxechotop20, max(echotop30) AS pf_coremaxechotop30,
         var_pop(x::DOUBLE) AS vx, var_pop(y::DOUBLE) AS vy, covar_pop(x::DOUBLE, y::DOUBLE) AS c
  FROM kreg GROUP BY 1, 2, 3),
core_features AS (
  SELECT *, 44.0::DOUBLE * sqrt((vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + c * c)) AS pf_coremajoraxis FROM kmom)
""")


def core_rows(st: Stages):
    return st.keep(
        "core_features",
        lambda: precip.core_features(echo_pixels(st), st.ws, "core", PIXEL_KM, None, 0, (20, 30), (NY, NX)),
    )


CORE = "pf_corelon pf_corelat pf_corearea pf_coremajoraxis pf_coremaxechotop20 pf_coremaxechotop30"


@query("core_features", sql.query("core_features", f"SELECT track_id, frame_id, core_rank, npix, {sql.rnd(CORE)} FROM core_features"))
def core_features(spark, sf):
    out = core_rows(Stages(spark, sf))
    return rounded(out.select("track_id", "frame_id", "core_rank", "npix", *CORE.split()))


@query("robust_by_radar", sql.query(("echo_extras", "rain_features"), """
SELECT track_id, time_idx, period_h FROM (
  SELECT *, (max(time_idx) OVER i - min(time_idx) OVER i + 1) * 1.0::DOUBLE AS period_h FROM (
    SELECT *, sum(opens) OVER (PARTITION BY track_id ORDER BY time_idx) AS island FROM (
      SELECT e.track_id, e.time_idx, count(*) OVER (PARTITION BY e.track_id) AS n,
             CASE WHEN e.time_idx - lag(e.time_idx) OVER (PARTITION BY e.track_id ORDER BY e.time_idx) > 1 THEN 1 ELSE 0 END AS opens
      FROM echo_extras e JOIN rain_features f ON f.track_id = e.track_id AND f.time_idx = e.time_idx AND f.pf_rank = 1
      WHERE f.pf_majoraxis >= 15 AND e.pf_cc45area > 0) WHERE n > 2)
  WINDOW i AS (PARTITION BY track_id, island)) WHERE period_h >= 2"""))
def robust_by_radar(spark, sf):
    st = Stages(spark, sf)
    largest = st.rain_features()[0].where("pf_rank = 1").select("track_id", "time_idx", "pf_majoraxis")
    rows = extras(st).join(largest, ["track_id", "time_idx"], "left")
    return systems.robust_by_radar(rows, 15.0, 2, 1, DT_H)


sql.fragment("life_stages", ("echo_extras", "core_features"), """
lc AS MATERIALIZED (
  SELECT * FROM (
    SELECT e.track_id, e.time_idx, e.pf_sfarea AS sf_area, c.core_area, c.core_axis,
           max(e.time_idx) OVER t + 1 AS len, avg(e.pf_sfarea) OVER t AS mean_sf
    FROM echo_extras e LEFT JOIN (
      SELECT track_id, frame_id, max(pf_corearea) AS core_area, max(pf_coremajoraxis) AS core_axis FROM core_features GROUP BY 1, 2) c
    USING (track_id, frame_id) WINDOW t AS (PARTITION BY e.track_id)) WHERE len * 1.0 >= 4),
lc_flag AS (
  SELECT 'cc' AS k, track_id, time_idx FROM lc WHERE core_area > 0
  UNION ALL SELECT 'line', track_id, time_idx FROM lc WHERE core_axis > 20
  UNION ALL SELECT 'sf', track_id, time_idx FROM lc WHERE core_axis > 20 AND sf_area > mean_sf),
lc_island AS (
  SELECT *, sum(opens) OVER (PARTITION BY k, track_id ORDER BY time_idx) AS island FROM (
    SELECT *, CASE WHEN time_idx - lag(time_idx) OVER (PARTITION BY k, track_id ORDER BY time_idx) > 2 THEN 1 ELSE 0 END AS opens FROM lc_flag)),
lc_run AS (
  SELECT k, track_id, island, count(*) AS n, min(time_idx) AS a, max(time_idx) AS z, list(time_idx ORDER BY time_idx) AS times
  FROM lc_island GROUP BY 1, 2, 3),
lc_best AS MATERIALIZED (
  SELECT k, track_id, a, z, CASE WHEN runs = 1 THEN range(a, z + 1) ELSE times END AS times FROM (
    SELECT *, count(*) OVER (PARTITION BY k, track_id) AS runs,
           row_number() OVER (PARTITION BY k, track_id ORDER BY n DESC, island) AS rn FROM lc_run) WHERE rn = 1),
lc_all AS (
  SELECT lc.*, cc.a AS cc_first, CASE WHEN len(li.times) > 1 THEN li.times[2] END AS second,
         CASE WHEN len(li.times) > 1 THEN sf.z END AS sf_last,
         CASE WHEN len(li.times) > 1 AND sf.a > li.times[2] + 2 THEN sf.a
              WHEN len(li.times) > 1 AND list_contains(sf.times, li.times[2] + 2) THEN li.times[2] + 2 END AS mature
  FROM lc JOIN lc_best cc ON cc.track_id = lc.track_id AND cc.k = 'cc'
  LEFT JOIN lc_best li ON li.track_id = lc.track_id AND li.k = 'line' LEFT JOIN lc_best sf ON sf.track_id = lc.track_id AND sf.k = 'sf'),
life_stages AS MATERIALIZED (
  SELECT track_id, time_idx, CASE
    WHEN sf_last < len - 1 AND time_idx > sf_last THEN 5
    WHEN mature IS NOT NULL AND time_idx BETWEEN mature AND sf_last THEN 4
    WHEN mature IS NOT NULL AND time_idx >= second AND time_idx < mature THEN 3
    WHEN second > cc_first AND time_idx >= cc_first AND time_idx < second THEN 2
    WHEN cc_first > 0 AND cc_first < len - 1 AND time_idx < cc_first THEN 1 END AS cycle_stage
  FROM lc_all)
""")


@query("life_cycle", sql.query("life_stages", """
SELECT track_id, time_idx, cycle_stage, CASE WHEN stages >= 4 THEN 1 END AS cycle_complete
FROM life_stages JOIN (SELECT track_id, count(DISTINCT cycle_stage) AS stages FROM life_stages GROUP BY 1) USING (track_id)"""))
def life_cycle(spark, sf):
    st = Stages(spark, sf)
    cores = core_rows(st).groupBy("track_id", "frame_id").agg(
        F.max("pf_corearea").alias("core_area"), F.max("pf_coremajoraxis").alias("core_axis")
    )
    rows = extras(st).select("track_id", "frame_id", "time_idx", F.col("pf_sfarea").alias("sf_area"))
    rows = rows.join(cores, ["track_id", "frame_id"], "left").drop("frame_id")
    return systems.life_cycle(rows, 4, DT_H, line_km=20.0)


@query("expand_cores_nearest", sql.query("core_ids", """
SELECT p.frame_id, p.y, p.x, coalesce(c0.core_id, (SELECT arg_min(k.core_id, d * 1000000 + k.core_id) FROM (
  SELECT k.core_id, min((k.y - p.y) * (k.y - p.y) + (k.x - p.x) * (k.x - p.x)) AS d FROM core_ids k
  WHERE k.frame_id = p.frame_id AND abs(k.y - p.y) <= 3 AND abs(k.x - p.x) <= 3
    AND (k.y - p.y) * (k.y - p.y) + (k.x - p.x) * (k.x - p.x) <= 9 GROUP BY 1) k), 0) AS cell
FROM comp p LEFT JOIN core_ids c0 USING (frame_id, y, x)"""))
def expand_cores_nearest(spark, sf):
    px = cells(Stages(spark, sf)).select("frame_id", "y", "x", "core_id")
    return image.expand_cores(px, "core_id", [3], 1000, 1000, nearest=True).select("frame_id", "y", "x", "cell")


@query("periodic_shift", sql.query("labels", """
SELECT frame_id, feature_id, CASE WHEN gap > 10 THEN CAST(20 - nx AS INTEGER) ELSE 0 END AS shift FROM (
  SELECT frame_id, feature_id, max(g) AS gap, arg_max(n, g * 1000 - x) AS nx FROM (
    SELECT *, coalesce(n - x, -1) AS g FROM (
      SELECT frame_id, feature_id, x, lead(x) OVER (PARTITION BY frame_id, feature_id ORDER BY x) AS n
      FROM (SELECT DISTINCT frame_id, feature_id, x FROM labels))) GROUP BY 1, 2)"""))
def periodic_shift(spark, sf):
    px = Stages(spark, sf).labels().select("frame_id", "feature_id", "x")
    return stats.periodic_shift(px, ["frame_id", "feature_id"], "x", NX)


@query("feature_bounds", sql.query("labels", """
SELECT frame_id, feature_id, CASE WHEN min(y) <= 3 THEN 0 ELSE min(y) - 3 END AS miny, CASE WHEN max(y) >= 17 THEN 20 ELSE max(y) + 4 END AS maxy,
       CASE WHEN min(x) <= 3 THEN 0 ELSE min(x) - 3 END AS minx, CASE WHEN max(x) >= 17 THEN 20 ELSE max(x) + 4 END AS maxx
FROM labels GROUP BY 1, 2"""))
def feature_bounds(spark, sf):
    return stats.feature_bounds(Stages(spark, sf).labels(), ["frame_id", "feature_id"], (NY, NX), margin=3)


@query("match_drift", sql.query(("frames", "drift"), """
SELECT frame_id, CASE WHEN min(y) = max(y) AND min(x) = max(x) THEN CAST(min(y) AS INTEGER) ELSE 0 END AS dy,
       CASE WHEN min(y) = max(y) AND min(x) = max(x) THEN CAST(min(x) AS INTEGER) ELSE 0 END AS dx
FROM frames LEFT JOIN drift USING (frame_id) GROUP BY 1"""))
def match_drift(spark, sf):
    """Shifts measured per tile: a frame whose tiles disagree has an ambiguous one, a frame before a gap none."""
    st = Stages(spark, sf)
    raw = st.keep("advection", lambda: moving.advection(st))
    moves = motion.smooth_advection(raw, PIXEL_KM, PIXEL_KM, STEP_S, 5)
    table = moves.join(st.frames().select("frame_id", "ts"), "frame_id").select(
        "ts", F.col("y").cast("int").alias("dy"), F.col("x").cast("int").alias("dx")
    )
    return drift.match_drift(st.frames(), table.distinct())


@query("low_level_reflectivity", sql.query("volume", """
SELECT frame_id, y, x, max(CASE WHEN d >= 2 THEN greatest(dbz, 12.0) END) FILTER (height_m BETWEEN 1500 AND 4000) AS dbz_low,
       max(CASE WHEN d >= 2 THEN greatest(dbz, 12.0) END) AS dbz_comp FROM volume GROUP BY 1, 2, 3"""))
def low_level_reflectivity(spark, sf):
    rows = volume(Stages(spark, sf)).withColumn(
        "dbz", physics.quality_mask(physics.sensitivity_floor("dbz", 12.0), "d", 2.0)
    )
    low = vertical.composite(rows, "dbz", "dbz_low", physics.low_level("height_m", 1500, 4000))
    return low.join(vertical.composite(rows, "dbz"), ["frame_id", "y", "x"])


@query("repaired_coordinates", sql.query(("field", "grid"), """
SELECT y, x, round(CASE WHEN lon - 21 < 0 THEN lon - 21 + 360 ELSE lon - 21 END, 9) AS lon, x - 9 AS ix,
       CASE WHEN sqrt((x - 9) * (x - 9) + (y - 9) * (y - 9)) <= 7 THEN 1 ELSE 0 END AS range_ok
FROM grid JOIN (SELECT DISTINCT y, x FROM field) USING (y, x)"""))
def repaired_coordinates(spark, sf):
    st = Stages(spark, sf)
    used = st.field().select("y", "x").distinct()
    ix, iy = geo.semi_symmetric("x", NX), geo.semi_symmetric("y", NY)
    return rounded(
        st.grid().join(used, ["y", "x"]).select(
            "y", "x", geo.to_0_360(F.col("lon") - 21).alias("lon"), ix.alias("ix"), geo.range_mask(ix, iy, 7).alias("range_ok")
        )
    )
