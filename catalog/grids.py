"""Field conversions, selections, grids and remapping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import oracle as sql
from catalog.radar import comp
from catalog.registry import query
from catalog.stages import NX, NY, Stages, rounded
from driftfield.functions import geo, physics, timeparse
from driftfield.operators import image, label, link, regrid
from driftfield.sources import filters, tables


@query("cell_area", sql.query(("labels", "grid"), """
SELECT frame_id, feature_id, round(sum(area_km2), 5) AS area_km2, round(min(area_km2), 6) AS least_km2, round(max(area_km2), 6) AS most_km2
FROM labels JOIN grid USING (y, x) GROUP BY 1, 2"""))
def cell_area(spark, sf):
    st = Stages(spark, sf)
    out = st.labels().join(st.grid(), ["y", "x"]).groupBy("frame_id", "feature_id").agg(
        F.sum("area_km2").alias("area_km2"), F.min("area_km2").alias("least_km2"), F.max("area_km2").alias("most_km2")
    )
    return rounded(out, 6, area_km2=5)


@query("mean_spacing_area", sql.query("field", """
SELECT frame_id, round(sum(6371.0::DOUBLE * 6371 * cos(radians((y - 10) / 10.0::DOUBLE)) * radians(0.1::DOUBLE) * radians(0.1::DOUBLE)), 5) AS area_km2
FROM field WHERE tb < 241 GROUP BY 1"""))
def mean_spacing_area(spark, sf):
    st = Stages(spark, sf)
    grid = geo.with_mean_spacing_area(st.grid().drop("area_km2")).select("y", "x", "area_km2")
    out = st.field().where("tb < 241").join(grid, ["y", "x"]).groupBy("frame_id").agg(F.sum("area_km2").alias("area_km2"))
    return rounded(out, 9, area_km2=5)


@query("mean_pixel_length", sql.query(("labels", "grid"), """
SELECT frame_id, feature_id, round(sqrt(avg(area_km2)), 6) AS pixel_length FROM labels JOIN grid USING (y, x) GROUP BY 1, 2"""))
def mean_pixel_length(spark, sf):
    st = Stages(spark, sf)
    out = st.labels().join(st.grid(), ["y", "x"]).groupBy("frame_id", "feature_id")
    return rounded(out.agg(geo.mean_pixel_length().alias("pixel_length")), 6)


@query("olr_to_tb", sql.query("field", """
SELECT frame_id, y, x, CASE WHEN inner_part >= 0 THEN round((sqrt(greatest(inner_part, 0)) - 1.228) / (2 * -1.106e-3::DOUBLE), 6) END AS tb
FROM (SELECT *, 1.228::DOUBLE * 1.228 + 4 * -1.106e-3::DOUBLE * tf AS inner_part
      FROM (SELECT *, CASE WHEN 250 - 40 * z >= 0 THEN pow(greatest(250 - 40 * z, 0) / 5.67e-8::DOUBLE, 0.25) END AS tf FROM field))"""))
def olr_to_tb(spark, sf):
    px = Stages(spark, sf).field()
    return rounded(px.select("frame_id", "y", "x", physics.olr_to_tb(F.lit(250.0) - F.col("z") * 40.0).alias("tb")), 6)


@query("cloud_type", sql.query("field", """
SELECT frame_id, y, x, CASE WHEN tb < 225 THEN 1 WHEN tb < 241 THEN 2 WHEN tb < 255 THEN 3 WHEN tb < 261 THEN 4 ELSE 5 END AS cloudtype FROM field"""))
def cloud_type(spark, sf):
    return Stages(spark, sf).field().select("frame_id", "y", "x", physics.cloud_type("tb", 225, 241, 255, 261).alias("cloudtype"))


@query("valid_range", sql.query("field", "SELECT frame_id, y, x, CASE WHEN tb BETWEEN 215 AND 270 THEN tb END AS tb, greatest((rain - 3) * 0.5, 0) AS rain FROM field"))
def valid_range(spark, sf):
    px = Stages(spark, sf).field()
    return px.select("frame_id", "y", "x", physics.within("tb", 215, 270).alias("tb"), physics.scaled_rain(F.col("rain") - 3, 0.5).alias("rain"))


@query("field_threshold", sql.query("field", "SELECT frame_id, y, x, z FROM field WHERE z > 0.5 AND z < 2.5"))
def field_threshold(spark, sf):
    return Stages(spark, sf).field().where(filters.open_interval("z", 0.5, 2.5)).select("frame_id", "y", "x", "z")


@query("box_hull", sql.query(("field", "grid"), """
SELECT f.frame_id, f.y, f.x FROM field f, (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM grid
  WHERE lat BETWEEN -0.55 AND 0.45 AND lon BETWEEN 20.25 AND 21.35) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1"""))
def box_hull(spark, sf):
    st = Stages(spark, sf)
    return filters.box_hull(st.field(), st.grid(), (-0.55, 0.45), (20.25, 21.35)).select("frame_id", "y", "x")


@query("complete_frames", sql.query("field", """
SELECT frame_id, y, x FROM field JOIN (SELECT frame_id FROM field GROUP BY 1 HAVING (400 - count(tb)) / 400.0 < 0.02) USING (frame_id)"""))
def complete_frames(spark, sf):
    return filters.complete_frames(Stages(spark, sf).field(), "tb", 400, 0.02).select("frame_id", "y", "x")


@query("frame_pairs_timegap", sql.query("frames", """
SELECT a.frame_id, b.frame_id AS next_frame, (epoch(b.ts) - epoch(a.ts)) / 3600.0::DOUBLE AS dt_h
FROM frames a JOIN frames b ON b.frame_id = a.frame_id + 1 WHERE epoch(b.ts) - epoch(a.ts) < 744 * 3600"""))
def frame_pairs_timegap(spark, sf):
    frames = tables.frame_table(Stages(spark, sf).frames().select("ts"))
    return link.frame_pairs(frames, 744.0)


@query("coarsen_field", sql.query("field", "SELECT frame_id, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, round(avg(tb), 9) AS tb FROM field GROUP BY 1, 2, 3"))
def coarsen_field(spark, sf):
    return rounded(regrid.coarsen(Stages(spark, sf).field(), ["frame_id"], "tb", 3))


@query("coarsen_reflectivity", sql.query("volume", """
SELECT frame_id, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, round(10 * log10(avg(pow(10.0::DOUBLE, dbz_comp / 10))), 9) AS dbz_comp FROM comp GROUP BY 1, 2, 3"""))
def coarsen_reflectivity(spark, sf):
    return rounded(regrid.coarsen(comp(Stages(spark, sf)), ["frame_id"], "dbz_comp", 3, linear_z=True))


@query("refine_mask", sql.query("labels", """
SELECT frame_id, CAST(y * 3 + i AS INTEGER) AS y, CAST(x * 3 + j AS INTEGER) AS x, feature_id FROM labels, range(3) a(i), range(3) b(j)"""))
def refine_mask(spark, sf):
    return regrid.refine(Stages(spark, sf).labels(), 3).select("frame_id", "y", "x", "feature_id")


@query("weighted_remap", sql.query("field", """
SELECT frame_id, dy AS y, dx AS x, round(sum(w * tb) / sum(w), 9) AS tb FROM field JOIN (
  SELECT y, x, CAST(y // 4 AS INTEGER) AS dy, CAST(x // 4 AS INTEGER) AS dx, 1.0::DOUBLE + (y % 4) * (x % 4) AS w
  FROM (SELECT DISTINCT y, x FROM field)) USING (y, x) GROUP BY 1, 2, 3"""))
def weighted_remap(spark, sf):
    px = Stages(spark, sf).field()
    weights = px.select("y", "x").distinct().select(
        "y", "x", F.floor(F.col("y") / 4).cast("int").alias("dst_y"), F.floor(F.col("x") / 4).cast("int").alias("dst_x"),
        (F.lit(1.0) + (F.col("y") % 4) * (F.col("x") % 4)).alias("w"),
    )
    return rounded(regrid.apply_weights(px, weights, "tb"))


sql.fragment("healpix", ("field", "grid"), """
hp AS (
  SELECT y, x, CAST(floor((pmod_tt + 0.5) * 256 - zz * 192) AS BIGINT) AS jp, CAST(floor((pmod_tt + 0.5) * 256 + zz * 192) AS BIGINT) AS jm
  FROM (SELECT y, x, (lon / 90.0::DOUBLE) % 4 AS pmod_tt, sin(radians(lat)) AS zz FROM grid)),
hf AS (
  SELECT y, x, CAST(CASE WHEN jp // 256 = jm // 256 THEN (jp // 256) % 4 + 4 WHEN jp // 256 < jm // 256 THEN (jp // 256) % 4
                         ELSE (jm // 256) % 4 + 8 END AS BIGINT) AS face,
         CAST(jm % 256 AS BIGINT) AS ix, CAST(255 - jp % 256 AS BIGINT) AS iy FROM hp),
hcell AS (
  SELECT y, x, CAST(face * 65536 + list_sum([(((ix >> k) & 1) << (2 * k)) + (((iy >> k) & 1) << (2 * k + 1)) for k in range(8)]) AS BIGINT) AS cell FROM hf)
""")


@query("healpix_cells", sql.query("healpix", """
SELECT frame_id, cell, round(avg(tb), 9) AS tb, count(*) AS npix FROM field JOIN hcell USING (y, x) GROUP BY 1, 2"""))
def healpix_cells(spark, sf):
    """Mean temperature per nested cell of the pixels that fall into it."""
    st = Stages(spark, sf)
    grid = st.grid().withColumn("cell", regrid.nested_cell(F.col("lat"), F.col("lon"), 8))
    px = st.field().join(grid.select("y", "x", "cell"), ["y", "x"])
    return rounded(px.groupBy("frame_id", "cell").agg(F.avg("tb").alias("tb"), F.count(F.lit(1)).alias("npix")))


@query("nearest_remap", sql.query(("field", "grid"), """
SELECT c.cell, f.frame_id, f.tb FROM (
  SELECT y * 100 + x AS cell, lat + 0.03 AS lat_hp, lon - 0.04 AS lon_hp FROM (SELECT DISTINCT y, x FROM field) JOIN grid USING (y, x)) c
JOIN grid g ON g.y = CAST(round((lat_hp + 1.0) / 0.1) AS INTEGER) AND g.x = CAST(round((lon_hp - 20.0) / 0.1) AS INTEGER)
JOIN field f ON f.y = g.y AND f.x = g.x WHERE abs(g.lat - lat_hp) < 0.0572265625 AND abs(g.lon - lon_hp) < 0.0572265625"""))
def nearest_remap(spark, sf):
    st = Stages(spark, sf)
    cells = st.field().select("y", "x").distinct().join(st.grid(), ["y", "x"]).select(
        (F.col("y") * 100 + F.col("x")).alias("cell"), (F.col("lat") + 0.03).alias("lat_hp"), (F.col("lon") - 0.04).alias("lon_hp")
    )
    px = st.field().select("frame_id", "y", "x", "tb").join(st.grid().select("y", "x", "lat", "lon"), ["y", "x"])
    return regrid.grid_to_cells(px, cells, -1.0, 20.0, 0.1, regrid.cell_tolerance(10)).select("cell", "frame_id", "tb")


@query("hourly_combine", sql.query((), """
ev AS (SELECT date_trunc('hour', ts) AS ts, CAST((user_id // 16) % 16 AS INTEGER) AS y, CAST(user_id % 16 AS INTEGER) AS x, event_type, value FROM events),
a AS (SELECT ts, y, x, avg(value) AS clicks FROM ev WHERE event_type = 'click' GROUP BY 1, 2, 3),
b AS (SELECT ts, y, x, avg(value) AS views FROM ev WHERE event_type <> 'click' GROUP BY 1, 2, 3)
SELECT ts, y, x, round(clicks, 9) AS clicks, round(views, 9) AS views FROM a JOIN b USING (ts, y, x)"""))
def hourly_combine(spark, sf):
    u = F.col("user_id")
    ev = Stages(spark, sf).table("events").select(
        "ts", (F.floor(u / 16) % 16).cast("int").alias("y"), (u % 16).cast("int").alias("x"), "event_type", "value"
    )
    clicks = regrid.hourly_mean(ev.where("event_type = 'click'").withColumnRenamed("value", "clicks"), "clicks")
    views = regrid.hourly_mean(ev.where("event_type <> 'click'").withColumnRenamed("value", "views"), "views")
    return rounded(regrid.combine_fields(clicks, views))


@query("smooth_field", sql.query("field", """
SELECT a.frame_id, a.y, a.x, round(avg(b.tb), 9) AS smooth FROM field a, range(-2, 3) d(i), range(-2, 3) e(j)
JOIN field b ON b.frame_id = a.frame_id AND b.y = greatest(0, least(19, a.y + i)) AND b.x = greatest(0, least(19, a.x + j))
GROUP BY 1, 2, 3"""))
def smooth_field(spark, sf):
    px = Stages(spark, sf).field().select("frame_id", "y", "x", "tb")
    return rounded(image.smooth_box(px, "tb", 5, (NY, NX)).drop("tb"))


@query("fill_missing_median", sql.query("field", """
SELECT p.frame_id, p.y, p.x, CASE WHEN gap THEN m ELSE p.tb END AS tb FROM (
  SELECT frame_id, y, x, tb, z > 2 AS gap FROM field) p LEFT JOIN (
  SELECT frame_id, y, x, nullif(list_sort(list(v))[13], 1e9) AS m FROM (
    SELECT a.frame_id, a.y, a.x, CASE WHEN a.y + i NOT BETWEEN 0 AND 19 OR a.x + j NOT BETWEEN 0 AND 19 THEN 0.0::DOUBLE
           WHEN b.z > 2 OR b.tb IS NULL THEN 1e9::DOUBLE ELSE b.tb END AS v
    FROM field a, range(-2, 3) d(i), range(-2, 3) e(j) LEFT JOIN field b ON b.frame_id = a.frame_id AND b.y = a.y + i AND b.x = a.x + j
    WHERE a.z > 2) GROUP BY 1, 2, 3) m USING (frame_id, y, x)"""))
def fill_missing_median(spark, sf):
    # the whole frame box takes part, so absent grid pixels are rows with a missing value
    st = Stages(spark, sf)
    px = st.field().select("frame_id", "y", "x", F.when(F.col("z") <= 2, F.col("tb")).alias("tb"), F.lit(True).alias("real"))
    rows, cols = F.sequence(F.lit(0), F.lit(NY - 1)), F.sequence(F.lit(0), F.lit(NX - 1))
    cells = st.frames().select("frame_id", F.explode(rows).alias("y")).withColumn("x", F.explode(cols))
    full = cells.join(px, ["frame_id", "y", "x"], "left")
    return image.fill_median(full, "tb", 5, shape=(NY, NX)).where("real").select("frame_id", "y", "x", "tb")


@query("cell_bounds", sql.query(("grid", "field"), """
SELECT y, x, round(lat - 0.05, 9) + 0.0::DOUBLE AS lat_lo, round(lat + 0.05, 9) + 0.0::DOUBLE AS lat_hi, round(lon - 0.05, 9) AS lon_lo, round(lon + 0.05, 9) AS lon_hi
FROM grid JOIN (SELECT DISTINCT y, x FROM field) USING (y, x)"""))
def cell_bounds(spark, sf):
    st = Stages(spark, sf)
    bounded = geo.cell_bounds(geo.cell_bounds(st.grid(), "lat", "y", ["x"]), "lon", "x", ["y"])
    used = st.field().select("y", "x").distinct()
    return rounded(bounded.join(used, ["y", "x"]).select("y", "x", "lat_lo", "lat_hi", "lon_lo", "lon_hi"))


@query("haversine_steps", sql.query("series", """
SELECT track_id, time_idx, round(2 * 6371 * asin(sqrt(pow(sin(radians(meanlat - la) / 2), 2)
       + cos(radians(la)) * cos(radians(meanlat)) * pow(sin(radians(meanlon - lo) / 2), 2))), 6) AS km
FROM (SELECT *, lag(meanlat) OVER w AS la, lag(meanlon) OVER w AS lo FROM series WINDOW w AS (PARTITION BY track_id ORDER BY time_idx))"""))
def haversine_steps(spark, sf):
    w = Window.partitionBy("track_id").orderBy("time_idx")
    rows = Stages(spark, sf).series().withColumns({"_la": F.lag("meanlat").over(w), "_lo": F.lag("meanlon").over(w)})
    return rounded(rows.select("track_id", "time_idx", geo.haversine_km("_la", "_lo", "meanlat", "meanlon").alias("km")), 6)


@query("file_name_times", sql.query((), """
names AS (SELECT DISTINCT strftime(ts, 'cloudid_%Y%m%d_%H%M.nc') AS name, date_trunc('minute', ts) AS ts, strftime(ts, '%Y%m%d.%H%M') AS text FROM events)
SELECT name, ts, CAST(epoch(ts) AS BIGINT) AS epoch_s FROM names"""))
def file_name_times(spark, sf):
    ev = Stages(spark, sf).table("events")
    names = ev.select(
        F.concat(F.lit("cloudid_"), F.date_format("ts", "yyyyMMdd_HHmm"), F.lit(".nc")).alias("name"),
        F.date_format("ts", "yyyyMMdd.HHmm").alias("text"),
    ).distinct()
    return names.select(
        "name", timeparse.name_time("name", "cloudid_", "yyyyoodd_hhmm").alias("ts"), timeparse.compact_epoch("text").alias("epoch_s")
    )


@query("time_range", sql.query((), "ev AS (SELECT * FROM events) SELECT event_id FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'"))
def time_range(spark, sf):
    ev = Stages(spark, sf).table("events")
    return filters.time_range(ev, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12 12:00:00").cast("timestamp")).select("event_id")


@query("start_end_time", "SELECT min(ts) AS start, max(ts) AS \"end\" FROM events")
def start_end_time(spark, sf):
    return filters.start_end(Stages(spark, sf).table("events"))


@query("hourly_frames", "SELECT event_id FROM events WHERE abs(minute(ts) - 30) < 5")
def hourly_frames(spark, sf):
    return filters.hourly_frames(Stages(spark, sf).table("events"), 30, 5).select("event_id")


@query("common_times", "SELECT event_id FROM events WHERE event_type = 'click' AND date_trunc('hour', ts) IN (SELECT date_trunc('hour', ts) FROM events WHERE event_type = 'error')")
def common_times(spark, sf):
    ev = Stages(spark, sf).table("events").withColumn("hour", F.date_trunc("hour", "ts"))
    return filters.common_times(ev.where("event_type = 'click'"), ev.where("event_type = 'error'"), "hour").select("event_id")


@query("round_to_second", "SELECT event_id, date_trunc('second', ts + INTERVAL 500 MILLISECOND) AS ts FROM events")
def round_to_second(spark, sf):
    return Stages(spark, sf).table("events").select("event_id", timeparse.round_to_second("ts").alias("ts"))


@query("calendar_times", "SELECT event_id, CASE WHEN event_id % 31 + 1 <= day(last_day(ts + INTERVAL 1 MONTH)) THEN CAST(date_trunc('month', ts) + INTERVAL 1 MONTH + to_days(CAST(event_id % 31 AS INTEGER)) AS TIMESTAMP) END AS ts FROM events")
def calendar_times(spark, sf):
    ev = Stages(spark, sf).table("events")
    zero = F.lit(0)
    nxt = F.add_months("ts", 1)
    t = timeparse.calendar_time(F.year(nxt), F.month(nxt), (F.col("event_id") % 31 + 1).cast("int"), zero, zero, zero.cast("decimal(8,6)"))
    return ev.select("event_id", t.alias("ts"))


sql.fragment("tiled_regions", ("field",), sql.regions_sql("tiled_regions", "field", "tb < 250"))
sql.fragment("periodic_regions", ("field",), sql.regions_sql(
    "periodic_regions", "field", "tb < 250",
    " OR (a.y = b.y AND abs(a.x - b.x) = 19) OR (a.x = b.x AND abs(a.y - b.y) = 19)"))


@query("label_components_tiled", sql.query("tiled_regions", "SELECT frame_id, y, x, region FROM tiled_regions"))
def label_components_tiled(spark, sf):
    """Small tiles, so most regions are merged across tile edges."""
    st = Stages(spark, sf)
    return label.label_regions(st.field().where("tb < 250").select("frame_id", "y", "x"), st.ws, tile=6)


@query("label_components_periodic", sql.query("periodic_regions", "SELECT frame_id, y, x, region FROM periodic_regions"))
def label_components_periodic(spark, sf):
    st = Stages(spark, sf)
    px = st.field().where("tb < 250").select("frame_id", "y", "x")
    return label.label_regions(px, st.ws, shape=(NY, NX), periodic_y=True, periodic_x=True)


@query("sort_renumber_area", sql.query(("regions", "grid"), """
SELECT frame_id, region, npix, round(area, 6) AS area, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY npix DESC, region DESC) AS INTEGER) AS feature_id
FROM (SELECT frame_id, region, count(*) AS npix, sum(area_km2) AS area FROM regions JOIN grid USING (y, x) GROUP BY 1, 2 HAVING sum(area_km2) > 300)"""))
def sort_renumber_area(spark, sf):
    st = Stages(spark, sf)
    px = st.regions().join(st.grid().select("y", "x", "area_km2"), ["y", "x"])
    return rounded(label.rank_regions(px, min_area=300.0, area_col="area_km2"), 6)


@query("sort_renumber_two_masks", sql.query("labels", """
SELECT l.frame_id, l.y, l.x, coalesce(a.n, 0) AS feature_id, coalesce(b.n, 0) AS second
FROM (SELECT *, feature_id + (x % 2) AS second FROM labels) l
LEFT JOIN r AS a ON a.frame_id = l.frame_id AND a.feature_id = l.feature_id
LEFT JOIN r AS b ON b.frame_id = l.frame_id AND b.feature_id = l.second""").replace("\nSELECT l.frame_id", """,
r AS (SELECT frame_id, feature_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY k DESC, feature_id DESC) AS INTEGER) AS n
      FROM (SELECT frame_id, feature_id, count(*) AS k FROM labels GROUP BY 1, 2 HAVING count(*) > 2))
SELECT l.frame_id""", 1))
def sort_renumber_two_masks(spark, sf):
    px = Stages(spark, sf).labels().withColumn("second", F.col("feature_id") + F.col("x") % 2)
    out, _ = label.renumber_pair(px, "feature_id", "second", min_npix=2)
    return out.select("frame_id", "y", "x", "feature_id", "second")
