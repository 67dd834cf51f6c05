"""Maps, histograms, cycles and densities over tracked pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as sql
from catalog.registry import query
from catalog.stages import DT_H, Stages, rounded
from driftfield.operators import analysis, mapback
from driftfield.sources import filters

EDGES = [0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 20.0]

sql.fragment("tracked_field", ("pixel_tracks",), """
tracked_field AS MATERIALIZED (
  SELECT f.frame_id, f.y, f.x, f.tb, f.rain, year(t.ts) AS period, month(t.ts) AS month, f.frame_id % 24 AS hour,
         coalesce(p.feature_id, 0) AS cloudnumber, coalesce(p.cloudtracknumber, 0) AS cloudtracknumber,
         CASE WHEN f.rain > 3 THEN coalesce(p.cloudtracknumber, 0) ELSE 0 END AS pcptracknumber
  FROM field f JOIN frames t USING (frame_id) LEFT JOIN pixel_tracks p USING (frame_id, y, x))
""")


def tracked_field(st: Stages):
    def build():
        mapped = mapback.map_tracks(st.labels(), st.assignment()).select(
            "frame_id", "y", "x", F.col("feature_id").alias("cloudnumber"), "cloudtracknumber"
        )
        clock = st.frames().select(
            "frame_id", F.year("ts").alias("period"), F.month("ts").alias("month"), (F.col("frame_id") % 24).alias("hour")
        )
        out = st.field().select("frame_id", "y", "x", "tb", "rain").join(clock, "frame_id")
        out = out.join(mapped, ["frame_id", "y", "x"], "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cloudnumber", "cloudtracknumber")})
        return out.withColumn("pcptracknumber", F.when(F.col("rain") > 3, F.col("cloudtracknumber")).otherwise(0))

    return st.keep("tracked_field", build)


@query("monthly_rain_map", sql.query("tracked_field", """
SELECT month_of, y, x, round(sum(rain), 9) + 0.0::DOUBLE AS precipitation,
       round(coalesce(sum(rain) FILTER (cloudtracknumber > 0), 0), 9) + 0.0::DOUBLE AS mcs_precipitation,
       count(*) FILTER (cloudtracknumber > 0) AS mcs_cloud_count, count(*) FILTER (pcptracknumber > 0) AS mcs_precipitation_count,
       count(*) FILTER (rain > 2) AS precipitation_count, any_value(n) AS ntimes
FROM (SELECT *, period * 100 + month AS month_of FROM tracked_field)
JOIN (SELECT year(ts) * 100 + month(ts) AS month_of, count(*) AS n FROM frames GROUP BY 1) USING (month_of) GROUP BY 1, 2, 3"""))
def monthly_rain_map(spark, sf):
    st = Stages(spark, sf)
    px = tracked_field(st).withColumn("month_of", F.col("period") * 100 + F.col("month"))
    frames = st.frames().select("frame_id", (F.year("ts") * 100 + F.month("ts")).alias("month_of"))
    return rounded(analysis.month_map(px, frames, "month_of", rain_min=2.0))


@query("hovmoller_rain", sql.query("tracked_field", f"""
SELECT frame_id, x, {sql.rnd('precipitation mcs_precipitation')} FROM (
  SELECT frame_id, x, avg(rain) AS precipitation, avg(CASE WHEN pcptracknumber > 0 THEN rain ELSE 0 END) AS mcs_precipitation
  FROM tracked_field WHERE y BETWEEN 4 AND 15 GROUP BY 1, 2)"""))
def hovmoller_rain(spark, sf):
    return rounded(analysis.hovmoller(tracked_field(Stages(spark, sf)), F.col("y").between(4, 15)))


HIST = f"""
hist AS MATERIALIZED (
  WITH b AS (
    SELECT *, CASE WHEN x < 10 THEN 'land' ELSE 'ocean' END AS surface,
           least(len(list_filter({EDGES}, lambda e: e <= rain)), {len(EDGES) - 1}) - 1 AS bin
    FROM tracked_field WHERE rain BETWEEN {EDGES[0]} AND {EDGES[-1]}),
  c AS (
    SELECT 'total' AS category, surface, bin FROM b
    UNION ALL SELECT 'mcs', surface, bin FROM b WHERE cloudtracknumber > 0
    UNION ALL SELECT 'idc', surface, bin FROM b WHERE cloudnumber > 0 AND cloudtracknumber = 0
    UNION ALL SELECT 'congestus', surface, bin FROM b WHERE cloudnumber = 0 AND tb < 310 AND rain > 0.5)
  SELECT category, surface, bin, count(*) AS n FROM c GROUP BY 1, 2, 3)
"""
sql.fragment("hist", ("tracked_field",), HIST)


def _hist(st: Stages):
    return analysis.rain_histograms(tracked_field(st), EDGES, F.col("x") < 10, F.col("x") >= 10)


@query("rain_rate_histograms", sql.query("hist", "SELECT * FROM hist"))
def rain_rate_histograms(spark, sf):
    return _hist(Stages(spark, sf))


@query("rain_rate_pdf", sql.query("hist", f"""
SELECT category, surface, bin, n, {sql.rnd('pdf amount cum_amount')} FROM (
  SELECT *, sum(amount) OVER (PARTITION BY category, surface ORDER BY bin) AS cum_amount FROM (
    SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY category, surface) AS pdf, n * ({EDGES})[bin + 1]::DOUBLE AS amount FROM hist))"""))
def rain_rate_pdf(spark, sf):
    return rounded(analysis.normalise_histograms(_hist(Stages(spark, sf)), EDGES))


sql.fragment("stats_for_map", ("system_series", "ends", "rain_features", "rain_totals"), """
stats_for_map AS MATERIALIZED (
  SELECT s.track_id, s.frame_id, s.time_idx, year(f0.ts) AS period, e.track_duration * 1.0::DOUBLE AS lifetime,
         e.start_split_cloudnumber IS NULL AS starts, s.ccs_area, p.pf_area, t.total_rain, p.pf_maxrainrate
  FROM system_series s JOIN ends e USING (track_id) JOIN frames f0 ON f0.epoch_s = e.start_basetime
  LEFT JOIN rain_features p ON p.track_id = s.track_id AND p.frame_id = s.frame_id AND p.pf_rank = 1
  LEFT JOIN rain_totals t ON t.track_id = s.track_id AND t.frame_id = s.frame_id)
""")


def stats_for_map(st: Stages):
    def build():
        clock = st.frames().select(F.col("epoch_s").alias("start_basetime"), F.year("ts").alias("period"))
        ends = st.ends().join(clock, "start_basetime").select(
            "track_id", "period",
            (F.col("track_duration") * DT_H).alias("lifetime"),
            F.col("start_split_cloudnumber").isNull().alias("starts"),
        )
        pf = st.rain_features()[0].where("pf_rank = 1").select("track_id", "frame_id", "pf_area", "pf_maxrainrate")
        tot = st.rain_totals().select("track_id", "frame_id", "total_rain")
        base = st.system_series().select("track_id", "frame_id", "time_idx", "ccs_area")
        return (
            base.join(ends, "track_id").join(pf, ["track_id", "frame_id"], "left").join(tot, ["track_id", "frame_id"], "left")
        )

    return st.keep("stats_for_map", build)


def _system_cover(st: Stages):
    return tracked_field(st).where("cloudtracknumber > 0").select(
        F.col("cloudtracknumber").alias("track_id"), "frame_id", "y", "x", (F.col("pcptracknumber") > 0).alias("wet")
    )


@query("statistics_map", sql.query(("stats_for_map", "tracked_field"), f"""
SELECT period, y, x, nhour_ccs, nhour_pf, nmcs_ccs, nmcs_pf, initiation, {sql.rnd('ccs_area pf_area total_rain pf_maxrainrate')} FROM (
  SELECT s.period, c.y, c.x, count(*) AS nhour_ccs, count(*) FILTER (pcptracknumber > 0) AS nhour_pf,
         count(DISTINCT s.track_id) AS nmcs_ccs, count(DISTINCT s.track_id) FILTER (pcptracknumber > 0) AS nmcs_pf,
         count(*) FILTER (starts AND time_idx = 0) AS initiation, coalesce(sum(ccs_area), 0) / count(*) AS ccs_area,
         coalesce(sum(pf_area) FILTER (pcptracknumber > 0), 0) / nullif(count(*) FILTER (pcptracknumber > 0), 0) AS pf_area,
         coalesce(sum(total_rain) FILTER (pcptracknumber > 0), 0) / nullif(count(*) FILTER (pcptracknumber > 0), 0) AS total_rain,
         coalesce(sum(pf_maxrainrate) FILTER (pcptracknumber > 0), 0) / nullif(count(*) FILTER (pcptracknumber > 0), 0) AS pf_maxrainrate
  FROM tracked_field c JOIN stats_for_map s ON s.track_id = c.cloudtracknumber AND s.frame_id = c.frame_id GROUP BY 1, 2, 3)"""))
def statistics_map(spark, sf):
    st = Stages(spark, sf)
    return rounded(analysis.statistics_map(_system_cover(st), stats_for_map(st), ["total_rain", "pf_maxrainrate"], "period"))


@query("lifetime_map", sql.query(("stats_for_map", "tracked_field"), f"""
SELECT period, y, x, {sql.rnd('lifetime_mean lifetime_p50 lifetime_p75 lifetime_p90 lifetime_p95')} FROM (
  SELECT period, y, x, avg(lifetime) AS lifetime_mean, quantile_cont(lifetime, 0.5) AS lifetime_p50,
         quantile_cont(lifetime, 0.75) AS lifetime_p75, quantile_cont(lifetime, 0.9) AS lifetime_p90, quantile_cont(lifetime, 0.95) AS lifetime_p95
  FROM (SELECT DISTINCT cloudtracknumber AS track_id, y, x FROM tracked_field WHERE cloudtracknumber > 0)
  JOIN (SELECT DISTINCT track_id, lifetime, period FROM stats_for_map) USING (track_id) GROUP BY 1, 2, 3)"""))
def lifetime_map(spark, sf):
    st = Stages(spark, sf)
    life = stats_for_map(st).select("track_id", "lifetime", "period").distinct()
    return rounded(analysis.lifetime_map(_system_cover(st), life, "period"))


SEASON = "CASE WHEN month IN (12, 1, 2) THEN 'DJF' WHEN month IN (3, 4, 5) THEN 'MAM' WHEN month IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"


@query("seasonal_rain", sql.query("tracked_field", f"""
SELECT season, y, x, {sql.rnd('mean_rain mcs_rain')} FROM (
  SELECT {SEASON} AS season, y, x, avg(rain) AS mean_rain, coalesce(sum(rain) FILTER (cloudtracknumber > 0), 0) AS mcs_rain
  FROM tracked_field GROUP BY 1, 2, 3)"""))
def seasonal_rain(spark, sf):
    px = tracked_field(Stages(spark, sf)).withColumn("season", analysis.season(F.col("month")))
    return rounded(
        px.groupBy("season", "y", "x").agg(
            F.avg("rain").alias("mean_rain"),
            F.coalesce(F.sum(F.when(F.col("cloudtracknumber") > 0, F.col("rain"))), F.lit(0.0)).alias("mcs_rain"),
        )
    )


@query("diurnal_cycle", sql.query("tracked_field", "SELECT x, CAST(hour AS INTEGER) AS hour, round(avg(rain), 11) + 0.0::DOUBLE AS rain FROM tracked_field GROUP BY 1, 2"))
def diurnal_cycle(spark, sf):
    return rounded(analysis.diurnal_cycle(tracked_field(Stages(spark, sf)), ["x"], F.col("hour"), "rain"), 11)


@query("diurnal_harmonics", sql.query("tracked_field", f"""
SELECT x, harmonic, {sql.rnd('amplitude phase variance', 6)} FROM (
  SELECT x, harmonic, 2 * sqrt(re * re + im * im) / 24 AS amplitude,
         CASE WHEN p1 < 0 THEN p1 + 24.0::DOUBLE / harmonic ELSE p1 END AS phase,
         100 * 0.5 * pow(2 * sqrt(re * re + im * im) / 24, 2) / tv AS variance
  FROM (
    SELECT *, CASE WHEN p0 > 24.0::DOUBLE / harmonic THEN p0 - 24.0::DOUBLE / harmonic ELSE p0 END AS p1 FROM (
      SELECT x, k AS harmonic, sum(v * cos(2 * pi() * k * hour / 24)) AS re, -sum(v * sin(2 * pi() * k * hour / 24)) AS im,
             24.0::DOUBLE / k - atan2(-sum(v * sin(2 * pi() * k * hour / 24)), sum(v * cos(2 * pi() * k * hour / 24))) * 24 / (2 * pi()) / k AS p0,
             0.5 * 4 / (24 * 24) * (24 * sum(v * v) - sum(v) * sum(v)) AS tv
      FROM (SELECT x, hour, avg(rain) AS v FROM tracked_field GROUP BY 1, 2), (SELECT unnest([1, 2]) AS k) GROUP BY 1, 2)))"""))
def diurnal_harmonics(spark, sf):
    cycle = analysis.diurnal_cycle(tracked_field(Stages(spark, sf)), ["x"], F.col("hour"), "rain")
    return rounded(analysis.harmonics(cycle, ["x"], 24, 2, value="rain"), 6)


@query("kernel_density", sql.query("ends", """
SELECT start_status, point, round(density, 9) + 0.0::DOUBLE AS density FROM (
  SELECT start_status, point, avg(exp(-0.5 * pow((track_duration - point) / 1.5, 2)) / (1.5 * sqrt(2 * pi()))) AS density
  FROM ends, (SELECT unnest([1.0::DOUBLE, 2.0, 4.0, 8.0, 12.0]) AS point) GROUP BY 1, 2)"""))
def kernel_density(spark, sf):
    return rounded(analysis.kernel_density(Stages(spark, sf).ends(), ["start_status"], "track_duration", [1, 2, 4, 8, 12], 1.5))


@query("occurrence_frequency", sql.query("tracked_field", """
SELECT y, x, round((count(*) FILTER (cloudtracknumber > 0))::DOUBLE / (SELECT count(DISTINCT frame_id) FROM tracked_field), 9) AS frequency
FROM tracked_field GROUP BY 1, 2"""))
def occurrence_frequency(spark, sf):
    return rounded(analysis.occurrence_frequency(tracked_field(Stages(spark, sf)), F.col("cloudtracknumber") > 0))


@query("tracks_in_region", sql.query("series", """
SELECT track_id, lifetime, start_month FROM (
  SELECT track_id, avg(meanlat) AS la, avg(meanlon) AS lo, count(*) * 1.0::DOUBLE AS lifetime, arg_min(month(f.ts), time_idx) AS start_month
  FROM series JOIN frames f USING (frame_id) GROUP BY 1)
WHERE la BETWEEN -0.8137 AND 0.6137 AND lo BETWEEN 20.2137 AND 21.5137 AND lifetime >= 3 AND start_month IN (4, 5, 6, 7, 8, 9)"""))
def tracks_in_region(spark, sf):
    st = Stages(spark, sf)
    rows = st.series().join(st.frames().select("frame_id", "ts"), "frame_id")
    return analysis.tracks_in_region(rows, (-0.8137, 0.6137), (20.2137, 21.5137), 3, [4, 5, 6, 7, 8, 9], F.month("ts"), DT_H)


@query("land_ocean_tracks", sql.query("rain_totals", """
SELECT track_id, round(f, 9) + 0.0::DOUBLE AS landfrac, CASE WHEN f >= 0.6 THEN 'land' WHEN f <= 0.4 THEN 'ocean' ELSE 'mixed' END AS surface
FROM (SELECT track_id, avg(pf_landfrac) AS f FROM rain_totals GROUP BY 1)"""))
def land_ocean_tracks(spark, sf):
    return rounded(analysis.land_or_ocean(Stages(spark, sf).rain_totals(), 0.6, 0.4))


@query("merge_split_class", sql.query("ends", """
SELECT track_id, CASE WHEN start_split_tracknumber IS NOT NULL AND end_merge_tracknumber IS NOT NULL THEN 'both'
  WHEN start_split_tracknumber IS NOT NULL THEN 'split' WHEN end_merge_tracknumber IS NOT NULL THEN 'merge' ELSE 'neither' END AS kind FROM ends"""))
def merge_split_class(spark, sf):
    return analysis.merge_split_class(Stages(spark, sf).ends())


@query("tracks_ever_cold", sql.query("series", "SELECT DISTINCT track_id FROM series WHERE corecold_mintb < 210"))
def tracks_ever_cold(spark, sf):
    return analysis.tracks_ever(Stages(spark, sf).series(), F.col("corecold_mintb") < 210)


@query("cells_by_hour", sql.query("series", """
SELECT CAST(frame_id % 24 AS INTEGER) AS hour, count(*) AS n, round(avg(area), 6) AS area FROM series GROUP BY 1"""))
def cells_by_hour(spark, sf):
    rows = Stages(spark, sf).series().groupBy((F.col("frame_id") % 24).cast("int").alias("hour"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("area").alias("area")))


@query("histogram_grouping_sets", sql.query("tracked_field", """
SELECT surface, system, count(*) AS n, round(sum(rain), 6) + 0.0::DOUBLE AS rain FROM (
  SELECT CASE WHEN x < 10 THEN 'land' ELSE 'ocean' END AS surface, CASE WHEN cloudtracknumber > 0 THEN 'inside' ELSE 'outside' END AS system, rain FROM tracked_field) GROUP BY CUBE (surface, system)"""))
def histogram_grouping_sets(spark, sf):
    px = tracked_field(Stages(spark, sf)).select(
        F.when(F.col("x") < 10, "land").otherwise("ocean").alias("surface"), F.when(F.col("cloudtracknumber") > 0, "inside").otherwise("outside").alias("system"), "rain"
    )
    return rounded(px.cube("surface", "system").agg(F.count(F.lit(1)).alias("n"), F.sum("rain").alias("rain")), 6)


@query("track_time_range", sql.query("series", "SELECT track_id, time_idx FROM series WHERE base_time BETWEEN 36000 AND 180000"))
def track_time_range(spark, sf):
    return filters.time_range(Stages(spark, sf).series(), 36000, 180000, "base_time").select("track_id", "time_idx")
