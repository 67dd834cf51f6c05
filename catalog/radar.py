"""Radar columns: classification, core growth, echo tops, cell statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as sql
from catalog.registry import query
from catalog.stages import NX, NY, Stages, rounded
from driftfield.functions import physics
from driftfield.operators import echo, image, stats, vertical

STEPS = physics.dilation_steps(25, 40, 5, 1, 1, 3)

sql.fragment("volume", ("frames",), """
volume AS MATERIALIZED (
  SELECT f.frame_id, CAST((l_partkey // 20) % 20 AS INTEGER) AS y, CAST(l_partkey % 20 AS INTEGER) AS x,
         CAST(l_linenumber - 1 AS INTEGER) AS z, l_linenumber * 1000.0::DOUBLE AS height_m,
         max(l_quantity) AS dbz, max(round(l_discount * 100)) AS d
  FROM lineitem l JOIN frames f ON f.ts = date_trunc('month', l.l_shipdate) GROUP BY ALL),
comp AS MATERIALIZED (SELECT frame_id, y, x, max(dbz) AS dbz_comp FROM volume GROUP BY 1, 2, 3)
""")


def volume(st: Stages):
    """frame_id, y, x, z, height_m, dbz, d: a reflectivity column per pixel."""

    def build():
        part = F.col("l_partkey")
        rows = st.table("lineitem").select(
            F.date_trunc("month", "l_shipdate").alias("ts"),
            (F.floor(part / NX) % NY).cast("int").alias("y"),
            (part % NX).cast("int").alias("x"),
            (F.col("l_linenumber") - 1).cast("int").alias("z"),
            "l_quantity", "l_discount",
        )
        px = rows.groupBy("ts", "y", "x", "z").agg(
            F.max("l_quantity").alias("dbz"), F.max(F.round(F.col("l_discount") * 100)).alias("d")
        )
        return px.join(st.frames().select("frame_id", "ts"), "ts").select(
            "frame_id", "y", "x", "z", ((F.col("z") + 1) * 1000.0).alias("height_m"), "dbz", "d"
        )

    return st.keep("volume", build)


def comp(st: Stages):
    return st.keep("comp", lambda: vertical.composite(volume(st), "dbz"))


def classified(st: Stages):
    return st.keep(
        "classified",
        lambda: echo.classify_echo(
            comp(st), st.ws, "dbz_comp", 1000, 1000, 3000, 10, 42, 46, 20, STEPS, 2, 4, (NY, NX)
        ),
    )


@query("composite_reflectivity", sql.query("volume", "SELECT * FROM comp"))
def composite_reflectivity(spark, sf):
    return comp(Stages(spark, sf))


sql.fragment("background", ("volume",), """
background AS MATERIALIZED (
  SELECT a.frame_id, a.y, a.x, a.dbz_comp, 10 * log10(sum(power(10.0::DOUBLE, b.dbz_comp / 10)) / count(*)) AS background
  FROM comp a JOIN comp b ON b.frame_id = a.frame_id AND abs(b.y - a.y) <= 3 AND abs(b.x - a.x) <= 3
   AND (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x) <= 9
  GROUP BY ALL)
""")


@query("background_intensity", sql.query("background", f"SELECT frame_id, y, x, {sql.rnd('dbz_comp background', 8)} FROM background"))
def background_intensity(spark, sf):
    return rounded(image.background_mean(comp(Stages(spark, sf)), "dbz_comp", 3000, 1000, 1000), 8)


sql.fragment("core_px", ("background",), """
core_px AS MATERIALIZED (
  SELECT *, CASE WHEN background < 0 THEN 10.0 WHEN background < 42 THEN 10 * cos(pi() * background / 84) ELSE 0 END AS peakedness,
         dbz_comp >= 46 OR dbz_comp - background >=
           CASE WHEN background < 0 THEN 10.0 WHEN background < 42 THEN 10 * cos(pi() * background / 84) ELSE 0 END AS core0,
         CASE WHEN background >= 40 THEN 3 WHEN background >= 35 THEN 3 WHEN background >= 30 THEN 3
              WHEN background >= 25 THEN 2 ELSE 1 END AS radius
  FROM background)
""")
sql.fragment("core_regions", ("core_px",), sql.regions_sql("core_regions", "core_px", "core0"))
sql.fragment("classified", ("core_regions",), """
core_kept AS MATERIALIZED (
  SELECT p.*, CASE WHEN k.n >= 2 THEN 1 ELSE 0 END AS core
  FROM core_px p
  LEFT JOIN (SELECT frame_id, y, x, count(*) OVER (PARTITION BY frame_id, region) AS n FROM core_regions) k USING (frame_id, y, x)),
core_dilated AS MATERIALIZED (
  SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM core_kept c WHERE c.core = 1 AND c.frame_id = p.frame_id
      AND abs(c.y - p.y) <= 3 AND abs(c.x - p.x) <= 3
      AND (c.y - p.y) * (c.y - p.y) + (c.x - p.x) * (c.x - p.x) <= c.radius * c.radius) THEN 1 ELSE 0 END AS mask0
  FROM core_kept p)
""")
sql.fragment("mask_regions", ("classified",), sql.regions_sql("mask_regions", "core_dilated", "mask0 = 1"))
sql.fragment("echo", ("mask_regions",), """
echo AS MATERIALIZED (
  SELECT p.frame_id, p.y, p.x, p.dbz_comp, p.background, p.peakedness, p.core,
         CASE WHEN k.n >= 4 THEN 1 ELSE 0 END AS conv_mask,
         CASE WHEN mask0 = 1 THEN 4 WHEN dbz_comp < 10 THEN 1 WHEN dbz_comp > 10 AND dbz_comp < 20 THEN 2
              WHEN core0 THEN 4 ELSE 3 END AS echo_class
  FROM core_dilated p
  LEFT JOIN (SELECT frame_id, y, x, count(*) OVER (PARTITION BY frame_id, region) AS n FROM mask_regions) k USING (frame_id, y, x))
""")


@query("classify_echo", sql.query("echo", f"SELECT frame_id, y, x, core, conv_mask, echo_class, {sql.rnd('dbz_comp background peakedness', 8)} FROM echo"))
def classify_echo(spark, sf):
    return rounded(classified(Stages(spark, sf)), 8)


@query("classify_echo_classic", sql.query("core_px", """
SELECT p.frame_id, p.y, p.x, CASE WHEN core0 THEN 1 ELSE 0 END AS core,
       CASE WHEN EXISTS (SELECT 1 FROM core_px c WHERE c.core0 AND c.frame_id = p.frame_id
          AND abs(c.y - p.y) <= 5 AND abs(c.x - p.x) <= 5
          AND (c.y - p.y) * (c.y - p.y) + (c.x - p.x) * (c.x - p.x)
              <= power(CASE WHEN c.background >= 40 THEN 5 WHEN c.background >= 35 THEN 4 WHEN c.background >= 30 THEN 3
                      WHEN c.background >= 25 THEN 2 WHEN c.background >= 20 THEN 1 ELSE 0 END, 2)) THEN 4
            WHEN dbz_comp < 10 THEN 1 WHEN dbz_comp > 10 AND dbz_comp < 20 THEN 2 WHEN core0 THEN 4 ELSE 3 END AS echo_class
FROM core_px p"""))
def classify_echo_classic(spark, sf):
    st = Stages(spark, sf)
    steps = echo.classic_steps(20, 5, 40)
    out = echo.classify_echo(comp(st), st.ws, "dbz_comp", 1000, 1000, 3000, 10, 42, 46, 20, steps, shape=(NY, NX))
    return out.select("frame_id", "y", "x", "core", "echo_class")


sql.fragment("core_labels", ("classified",), """
core_kept_px AS MATERIALIZED (SELECT frame_id, y, x FROM core_kept WHERE core = 1)
""")
sql.fragment("kept_regions", ("core_labels",), sql.regions_sql("kept_regions", "core_kept_px", "TRUE"))
sql.fragment("core_ids", ("kept_regions",), """
core_ids AS MATERIALIZED (
  SELECT frame_id, y, x, core_id FROM kept_regions JOIN (
    SELECT frame_id, region, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, region DESC) AS INTEGER) AS core_id
    FROM (SELECT frame_id, region, count(*) AS n FROM kept_regions GROUP BY 1, 2 HAVING count(*) > 1)) USING (frame_id, region)),
cells AS MATERIALIZED (
  SELECT p.frame_id, p.y, p.x, coalesce(c0.core_id, 0) AS core_id,
         coalesce(c0.core_id, (SELECT arg_min(k.core_id, ring * 1000000 + k.core_id) FROM (
           SELECT k.core_id, min(CASE WHEN (k.y - p.y) * (k.y - p.y) + (k.x - p.x) * (k.x - p.x) <= 1 THEN 1
                         WHEN (k.y - p.y) * (k.y - p.y) + (k.x - p.x) * (k.x - p.x) <= 4 THEN 2 ELSE 3 END) AS ring
           FROM core_ids k WHERE k.frame_id = p.frame_id AND abs(k.y - p.y) <= 3 AND abs(k.x - p.x) <= 3
            AND (k.y - p.y) * (k.y - p.y) + (k.x - p.x) * (k.x - p.x) <= 9 GROUP BY 1) k), 0) AS cell
  FROM comp p LEFT JOIN core_ids c0 USING (frame_id, y, x))
""")


def cells(st: Stages):
    def build():
        numbered = echo.number_cores(classified(st), st.ws, "core", 1, (NY, NX))
        px = numbered.select("frame_id", "y", "x", "dbz_comp", "core_id", "core", "echo_class")
        return image.expand_cores(px, "core_id", [1, 2, 3], 1000, 1000)

    return st.keep("cells", build)


@query("expand_cores", sql.query("core_ids", "SELECT frame_id, y, x, core_id, cell FROM cells"))
def expand_cores(spark, sf):
    return cells(Stages(spark, sf)).select("frame_id", "y", "x", "core_id", "cell")


@query("label_cells", sql.query("core_ids", "SELECT * FROM core_ids"))
def label_cells(spark, sf):
    return cells(Stages(spark, sf)).where("core_id > 0").select("frame_id", "y", "x", "core_id")


def _tops_sql(thresholds, gap=2):
    parts = []
    for t in thresholds:
        parts.append(f"""
  SELECT frame_id, y, x, {t} AS t, arg_max(height_m, z) AS top FROM (
    SELECT *, sum(o) OVER (PARTITION BY frame_id, y, x ORDER BY z) AS layer FROM (
      SELECT *, CASE WHEN z - lag(z) OVER (PARTITION BY frame_id, y, x ORDER BY z) > {gap} THEN 1 ELSE 0 END AS o
      FROM volume WHERE dbz > {t})) WHERE layer = 0 GROUP BY 1, 2, 3""")
    picks = ", ".join(f"max(top) FILTER (t = {t}) AS echotop{t}" for t in thresholds)
    return f"tops AS MATERIALIZED (SELECT frame_id, y, x, {picks} FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2, 3)"


sql.fragment("tops", ("volume",), _tops_sql((10, 20, 30, 40)))


@query("echo_top_height", sql.query("tops", "SELECT frame_id, y, x, echotop30 FROM tops WHERE echotop30 IS NOT NULL"))
def echo_top_height(spark, sf):
    return vertical.echo_top(volume(Stages(spark, sf)), "dbz", 30, 2, "echotop30")


@query("echo_top_heights", sql.query("tops", "SELECT v.frame_id, v.y, v.x, echotop10, echotop20, echotop30, echotop40 FROM comp v LEFT JOIN tops USING (frame_id, y, x)"))
def echo_top_heights(spark, sf):
    return vertical.echo_tops(volume(Stages(spark, sf)), "dbz", (10, 20, 30, 40), 2)


@query("echo_layers", sql.query("volume", """
SELECT frame_id, y, x, layer, arg_min(height_m, z) AS base_m, arg_max(height_m, z) AS top_m FROM (
  SELECT *, sum(o) OVER (PARTITION BY frame_id, y, x ORDER BY z) AS layer FROM (
    SELECT *, CASE WHEN z - lag(z) OVER (PARTITION BY frame_id, y, x ORDER BY z) > 1 THEN 1 ELSE 0 END AS o
    FROM volume WHERE dbz > 15)) GROUP BY 1, 2, 3, 4"""))
def echo_layers(spark, sf):
    return vertical.echo_layers(volume(Stages(spark, sf)), "dbz", 15, 1)


RADAR = " ".join(
    ["core_meanlat core_meanlon core_mean_y core_mean_x cell_meanlat cell_meanlon cell_mean_y cell_mean_x core_area cell_area max_dbz"]
    + [f"maxeth_{t}dbz" for t in (10, 20, 30, 40)]
)


@query("feature_stats_radar", sql.query(("core_ids", "tops", "grid"), f"""
SELECT frame_id, feature_id, npix, maxrange_flag, {sql.rnd('area meanlat meanlon ' + RADAR)} FROM (
  SELECT c.frame_id, c.cell AS feature_id, count(*) AS npix, sum(g.area_km2) AS area, avg(lat) AS meanlat, avg(lon) AS meanlon,
         avg(lat) FILTER (core_id > 0) AS core_meanlat, avg(lon) FILTER (core_id > 0) AS core_meanlon,
         avg((c.y - 9) * 1.0::DOUBLE) FILTER (core_id > 0) AS core_mean_y, avg((c.x - 9) * 1.0::DOUBLE) FILTER (core_id > 0) AS core_mean_x,
         avg(lat) AS cell_meanlat, avg(lon) AS cell_meanlon, avg((c.y - 9) * 1.0::DOUBLE) AS cell_mean_y, avg((c.x - 9) * 1.0::DOUBLE) AS cell_mean_x,
         coalesce(sum(g.area_km2) FILTER (core_id > 0), 0) AS core_area, sum(g.area_km2) AS cell_area, max(p.dbz_comp) AS max_dbz,
         min(CASE WHEN sqrt((c.y - 9) * (c.y - 9) + (c.x - 9) * (c.x - 9)) <= 8 THEN 1 ELSE 0 END) AS maxrange_flag,
         max(echotop10) AS maxeth_10dbz, max(echotop20) AS maxeth_20dbz, max(echotop30) AS maxeth_30dbz, max(echotop40) AS maxeth_40dbz
  FROM cells c JOIN grid g USING (y, x) JOIN comp p USING (frame_id, y, x) LEFT JOIN tops USING (frame_id, y, x)
  WHERE c.cell > 0 GROUP BY 1, 2)"""))
def feature_stats_radar(spark, sf):
    from driftfield.functions import geo

    st = Stages(spark, sf)
    tops = vertical.echo_tops(volume(st), "dbz", (10, 20, 30, 40), 2)
    px = (
        cells(st).where("cell > 0")
        .join(st.grid(), ["y", "x"])
        .join(tops, ["frame_id", "y", "x"], "left")
        .withColumns(
            {
                "x_km": geo.semi_symmetric("x", NX).cast("double"),
                "y_km": geo.semi_symmetric("y", NY).cast("double"),
                "is_core": (F.col("core_id") > 0).cast("int"),
                "feature_id": F.col("cell"),
            }
        )
        .withColumn("range_ok", geo.range_mask("x_km", "y_km", 8))
    )
    return rounded(stats.feature_stats(px, stats.radar_extras((10, 20, 30, 40))))


@query("box_mean_reflectivity", sql.query("volume", f"""
SELECT frame_id, y, x, {sql.rnd('dbz_mean', 8)} FROM (
  SELECT a.frame_id, a.y, a.x, 10 * log10(avg(power(10.0::DOUBLE, b.dbz_comp / 10))) AS dbz_mean
  FROM comp a JOIN comp b ON b.frame_id = a.frame_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3)"""))
def box_mean_reflectivity(spark, sf):
    out = image.box_mean_linear(comp(Stages(spark, sf)), "dbz_comp", 3, "dbz_mean")
    return rounded(out.drop("dbz_comp"), 8)


sql.fragment("cold_pool", ("volume",), """
buoy AS MATERIALIZED (
  SELECT frame_id, y, x, z, height_m, 9.81::DOUBLE * (300.0::DOUBLE + d / 10 - avg(300.0::DOUBLE + d / 10) OVER w) / avg(300.0::DOUBLE + d / 10) OVER w AS b
  FROM volume WINDOW w AS (PARTITION BY frame_id, z)),
low AS (
  SELECT *, z - row_number() OVER (PARTITION BY frame_id, y, x ORDER BY z) AS run FROM buoy WHERE b < -0.002),
layer AS (
  SELECT l.frame_id, l.y, l.x, list(b ORDER BY z) AS bs, list(height_m ORDER BY z) AS hs, len(list(b)) AS n
  FROM low l JOIN (SELECT frame_id, y, x, arg_min(b, z) AS sfc FROM buoy GROUP BY 1, 2, 3) s USING (frame_id, y, x)
  JOIN (SELECT frame_id, y, x, arg_min(run, z) AS run0 FROM low GROUP BY 1, 2, 3) r USING (frame_id, y, x)
  WHERE sfc < -0.002 AND run = run0 GROUP BY 1, 2, 3 HAVING count(*) > 1),
pool AS (
  SELECT *, CASE WHEN n = 2 THEN (bs[1] + bs[2]) / 2 * (hs[2] - hs[1]) ELSE
    list_sum([(hs[i + 2] - hs[i]) / 6 * (bs[i] * (2 - (hs[i + 2] - hs[i + 1]) / (hs[i + 1] - hs[i]))
      + bs[i + 1] * pow(hs[i + 2] - hs[i], 2) / ((hs[i + 1] - hs[i]) * (hs[i + 2] - hs[i + 1]))
      + bs[i + 2] * (2 - (hs[i + 1] - hs[i]) / (hs[i + 2] - hs[i + 1]))) for i in range(1, n - 1, 2)])
    + CASE WHEN n % 2 = 1 THEN 0 ELSE
        bs[n] * (2 * pow(hs[n] - hs[n - 1], 2) + 3 * (hs[n - 1] - hs[n - 2]) * (hs[n] - hs[n - 1])) / (6 * (hs[n] - hs[n - 2]))
        + bs[n - 1] * (pow(hs[n] - hs[n - 1], 2) + 3 * (hs[n - 1] - hs[n - 2]) * (hs[n] - hs[n - 1])) / (6 * (hs[n - 1] - hs[n - 2]))
        - bs[n - 2] * pow(hs[n] - hs[n - 1], 3) / (6 * (hs[n - 1] - hs[n - 2]) * (hs[n] - hs[n - 2])) END END AS integral
  FROM layer)
""")


@query("cold_pool_intensity", sql.query("cold_pool", """
SELECT frame_id, y, x, hs[1] AS cp_base, hs[n] AS cp_top, hs[n] - hs[1] AS cp_depth,
       round(CASE WHEN integral <= 0 THEN sqrt(-2 * integral) END, 6) + 0.0::DOUBLE AS cp_intensity FROM pool"""))
def cold_pool_intensity(spark, sf):
    rows = volume(Stages(spark, sf)).withColumn("theta", F.lit(300.0) + F.col("d") / 10)
    rows = rows.withColumn("buoyancy", physics.buoyancy("theta"))
    return rounded(vertical.cold_pool(rows, "buoyancy", -0.002, 0.0), 6)


POOL_SIGMA = 1.0

sql.fragment("cold_pool_smooth", ("volume", "cold_pool"), f"""
pool_sfc AS MATERIALIZED (
  SELECT v.frame_id, v.y, v.x, coalesce(CASE WHEN hs[1] = bot AND integral <= 0 THEN sqrt(-2 * integral) END, 0) AS i
  FROM (SELECT frame_id, y, x, min(height_m) AS bot FROM volume GROUP BY 1, 2, 3) v LEFT JOIN pool USING (frame_id, y, x)),
bell AS (
  SELECT d, exp(-0.5 * d * d / {POOL_SIGMA ** 2}) / sum(exp(-0.5 * d * d / {POOL_SIGMA ** 2})) OVER () AS w
  FROM (SELECT unnest(range(-{int(4 * POOL_SIGMA + 0.5)}, {int(4 * POOL_SIGMA + 0.5) + 1})) AS d)),
taps_y AS (
  SELECT c AS y, CASE WHEN c + d < 0 THEN -1 - c - d WHEN c + d > {NY - 1} THEN 2 * {NY} - 1 - c - d ELSE c + d END AS sy, w AS wy
  FROM bell, (SELECT unnest(range({NY})) AS c)),
taps_x AS (
  SELECT c AS x, CASE WHEN c + d < 0 THEN -1 - c - d WHEN c + d > {NX - 1} THEN 2 * {NX} - 1 - c - d ELSE c + d END AS sx, w AS wx
  FROM bell, (SELECT unnest(range({NX})) AS c)),
pool_y AS MATERIALIZED (
  SELECT p.frame_id, t.y, p.x, sum(i * wy) AS i FROM pool_sfc p JOIN taps_y t ON t.sy = p.y GROUP BY 1, 2, 3),
pool_smooth AS MATERIALIZED (
  SELECT s.frame_id, s.y, s.x, s.i AS cp_intensity, b.v AS smooth FROM pool_sfc s JOIN (
    SELECT p.frame_id, p.y, t.x, sum(i * wx) AS v FROM pool_y p JOIN taps_x t ON t.sx = p.x GROUP BY 1, 2, 3) b USING (frame_id, y, x))
""")


@query("cold_pool_smoothed", sql.query("cold_pool_smooth", f"SELECT frame_id, y, x, {sql.rnd('cp_intensity smooth', 6)} FROM pool_smooth"))
def cold_pool_smoothed(spark, sf):
    """From buoyancy to the smoothed intensity of cold pools that reach the ground; no pool is zero."""
    rows = volume(Stages(spark, sf)).withColumn("theta", F.lit(300.0) + F.col("d") / 10)
    rows = rows.withColumn("buoyancy", physics.buoyancy("theta"))
    ground = rows.groupBy("frame_id", "y", "x").agg(F.min("height_m").alias("zz_bot"))
    pools = vertical.surface_cold_pools(vertical.cold_pool(rows, "buoyancy", -0.002, 0.0), ground)
    field = ground.join(pools, ["frame_id", "y", "x"], "left").select(
        "frame_id", "y", "x", F.coalesce("cp_intensity", F.lit(0.0)).alias("cp_intensity")
    )
    return rounded(image.smooth_gaussian(field, "cp_intensity", POOL_SIGMA, (NY, NX)), 6)


@query("buoyancy", sql.query("volume", f"""
SELECT frame_id, y, x, z, {sql.rnd('buoyancy')} FROM (
  SELECT frame_id, y, x, z, 9.81::DOUBLE * (300.0::DOUBLE + d / 10 - avg(300.0::DOUBLE + d / 10) OVER w) / avg(300.0::DOUBLE + d / 10) OVER w AS buoyancy
  FROM volume WINDOW w AS (PARTITION BY frame_id, z))"""))
def buoyancy(spark, sf):
    rows = volume(Stages(spark, sf)).withColumn("theta", F.lit(300.0) + F.col("d") / 10)
    return rounded(rows.withColumn("buoyancy", physics.buoyancy("theta")).select("frame_id", "y", "x", "z", "buoyancy"))


@query("melting_height", sql.query("volume", f"""
SELECT frame_id, y, x, {sql.rnd('melting_height')} FROM (
  SELECT frame_id, y, x, arg_max(CASE WHEN t1 = t0 THEN h1 ELSE h0 + (h1 - h0) / (t1 - t0) * (0 - t0) END, z) AS melting_height
  FROM (SELECT frame_id, y, x, z, height_m AS h0, 12.0::DOUBLE - 5 * z + d - 5 AS t0,
               lead(height_m) OVER w AS h1, lead(12.0::DOUBLE - 5 * z + d - 5) OVER w AS t1
        FROM volume WINDOW w AS (PARTITION BY frame_id, y, x ORDER BY z)) WHERE t0 * t1 <= 0 GROUP BY 1, 2, 3)"""))
def melting_height(spark, sf):
    rows = volume(Stages(spark, sf)).withColumn("temp_c", F.lit(12.0) - F.col("z") * 5 + F.col("d") - 5)
    return rounded(vertical.melting_height(rows))


@query("interpolate_levels", sql.query("volume", f"""
SELECT frame_id, y, x, level_m, {sql.rnd('dbz', 8)} FROM (
  SELECT frame_id, y, x, level_m, 10 * log10(v + (v1 - v) * (level_m - height_m) / (h1 - height_m)) AS dbz
  FROM (SELECT *, power(10.0::DOUBLE, dbz / 10) AS v, lead(power(10.0::DOUBLE, dbz / 10)) OVER w AS v1, lead(height_m) OVER w AS h1
        FROM volume WINDOW w AS (PARTITION BY frame_id, y, x ORDER BY z)),
       (SELECT unnest([1500.0::DOUBLE, 2750.0::DOUBLE, 4000.0::DOUBLE]) AS level_m)
  WHERE level_m >= height_m AND level_m < h1)"""))
def interpolate_levels(spark, sf):
    return rounded(vertical.interpolate_levels(volume(Stages(spark, sf)), "dbz", [1500, 2750, 4000]), 8)


@query("accumulated_rain_rate", sql.query("field", f"""
SELECT frame_id, y, x, {sql.rnd('rainrate')} FROM (
  SELECT frame_id, y, x, (acc - lag(acc) OVER w) * 3600.0::DOUBLE / (epoch_s - lag(epoch_s) OVER w) AS rainrate
  FROM (SELECT frame_id, y, x, 3600 * frame_id AS epoch_s, sum(v) OVER (PARTITION BY y, x ORDER BY frame_id) AS acc FROM field)
  WINDOW w AS (PARTITION BY y, x ORDER BY epoch_s)) WHERE rainrate IS NOT NULL"""))
def accumulated_rain_rate(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("y", "x").orderBy("frame_id")
    acc = Stages(spark, sf).field().select(
        "frame_id", "y", "x", (F.col("frame_id") * 3600).alias("epoch_s"), F.sum("v").over(w).alias("acc")
    )
    return rounded(vertical.accumulated_to_rate(acc, "acc").select("frame_id", "y", "x", "rainrate"))
