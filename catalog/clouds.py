"""Cloud identification variants, rain linking, watershed, 3-D echo classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as sql
from catalog.radar import volume
from catalog.registry import query
from catalog.stages import NX, NY, OTHRESH, TB_CLOUD, TB_COLD, TB_CORE, TB_WARM, Stages
from driftfield.operators import clouds, combine, label, link, sl3d, tracks, watershed
from driftfield.sources import tables

TB = (TB_CORE, TB_COLD, TB_WARM, TB_CLOUD)


def _pixels(st: Stages):
    return st.field().select("frame_id", "y", "x", "tb", "rain").join(st.grid().select("y", "x", "area_km2"), ["y", "x"])


def grown(st: Stages):
    return st.keep(
        "grown",
        lambda: clouds.grow_cold_clouds(_pixels(st), st.ws, TB, 200.0, 0, 3, (NY, NX), warm_expansion=True),
    )


@query("label_grow_clouds")
def label_grow_clouds(spark, sf):
    return grown(Stages(spark, sf)).select("frame_id", "y", "x", "cloudtype", "convcold_cloudnumber", "cloudnumber")


@query("cloud_pixel_counts")
def cloud_pixel_counts(spark, sf):
    return clouds.cloud_counts(grown(Stages(spark, sf)))


sql.fragment("spread", ("regions", "grid"), """
spread0 AS MATERIALIZED (
  SELECT f.frame_id, f.y, f.x, f.tb, coalesce(k.n, 0) AS n FROM field f
  LEFT JOIN (SELECT r.frame_id, r.y, r.x, s.n FROM regions r JOIN (
      SELECT frame_id, region, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY c DESC, region DESC) AS INTEGER) AS n
      FROM (SELECT frame_id, region, count(*) AS c FROM regions JOIN grid USING (y, x) GROUP BY 1, 2 HAVING sum(area_km2) > 300)) s
    USING (frame_id, region)) k USING (frame_id, y, x)),
spread_step AS (
  SELECT frame_id, y, x, n, 0 AS ring FROM spread0 WHERE n > 0
  UNION
  SELECT o.frame_id, o.y, o.x, s.n, s.ring + 1 FROM spread_step s JOIN spread0 o
    ON o.frame_id = s.frame_id AND abs(o.y - s.y) + abs(o.x - s.x) = 1
  WHERE o.n = 0 AND o.tb < 261 AND s.ring < 40),
spread AS MATERIALIZED (
  SELECT f.frame_id, f.y, f.x, f.n AS convcold_cloudnumber, coalesce(s.n, 0) AS cloudnumber FROM spread0 f
  LEFT JOIN (SELECT frame_id, y, x, arg_min(n, ring * 100000 + n) AS n FROM spread_step GROUP BY 1, 2, 3) s USING (frame_id, y, x))
""")


@query("detect_and_spread", sql.query("spread", "SELECT frame_id, y, x, convcold_cloudnumber, cloudnumber FROM spread"))
def detect_and_spread(spark, sf):
    st = Stages(spark, sf)
    out = clouds.detect_and_spread(_pixels(st), st.ws, TB, 300.0, (NY, NX))
    return out.select("frame_id", "y", "x", "convcold_cloudnumber", "cloudnumber")


@query("detect_cold_areas", sql.query(("regions", "grid"), """
SELECT f.frame_id, f.y, f.x, coalesce(k.n, 0) AS cloudnumber FROM field f
LEFT JOIN (SELECT r.frame_id, r.y, r.x, s.n FROM regions r JOIN (
    SELECT frame_id, region, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY c DESC, region DESC) AS INTEGER) AS n
    FROM (SELECT frame_id, region, count(*) AS c FROM regions JOIN grid USING (y, x) GROUP BY 1, 2 HAVING sum(area_km2) > 300)) s
  USING (frame_id, region)) k USING (frame_id, y, x)"""))
def detect_cold_areas(spark, sf):
    st = Stages(spark, sf)
    out = clouds.detect_and_spread(_pixels(st), st.ws, TB, 300.0, (NY, NX), warm_expansion=False)
    return out.select("frame_id", "y", "x", "cloudnumber")


def _with_rain_features(st: Stages):
    def build():
        wet = st.field().where("rain > 4").select("frame_id", "y", "x")
        regions = st.ws.write(label.label_regions(wet, st.ws, shape=(NY, NX)), "wet")
        numbers = label.renumber(regions, label.rank_regions(regions, 1)).withColumnRenamed("feature_id", "pf_number")
        return grown(st).join(numbers, ["frame_id", "y", "x"], "left").withColumn("pf_number", F.coalesce("pf_number", F.lit(0)))

    return st.keep("rain_numbered", build)


@query("link_rain_clouds")
def link_rain_clouds(spark, sf):
    st = Stages(spark, sf)
    out = clouds.link_rain_clouds(_with_rain_features(st), st.ws)
    return out.select("frame_id", "y", "x", "pf_number", "convcold_cloudnumber", "pf_convcold_cloudnumber", "pf_cloudnumber")


@query("linked_clouds_renumbered")
def linked_clouds_renumbered(spark, sf):
    st = Stages(spark, sf)
    linked = clouds.link_rain_clouds(_with_rain_features(st), st.ws).select(
        "frame_id", "y", "x", "pf_convcold_cloudnumber", "pf_cloudnumber"
    )
    out, _ = label.renumber_pair(st.ws.write(linked, "linked"), "pf_convcold_cloudnumber", "pf_cloudnumber", min_npix=1)
    return out


sql.fragment("peaks", ("field",), """
peaks AS (
  SELECT a.frame_id, a.y, a.x FROM field a JOIN field b ON b.frame_id = a.frame_id AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2
  WHERE a.z > 0.8 GROUP BY a.frame_id, a.y, a.x, a.z HAVING a.z >= max(b.z))
""")


@query("local_peaks", sql.query("peaks", "SELECT * FROM peaks"))
def local_peaks(spark, sf):
    from driftfield.operators import image

    st = Stages(spark, sf)
    px = st.field().select("frame_id", "y", "x", "z")
    return image.local_peaks(px, "z", 2, 0.8, 0, (NY, NX)).where("is_peak").select("frame_id", "y", "x")


# the order of a pixel: the passes on the way to it, each lower than the one before, with the steps on its level
sql.fragment("watershed", ("peaks",), """
wp AS MATERIALIZED (SELECT frame_id, y, x, z FROM peaks JOIN field USING (frame_id, y, x)),
wp_near AS MATERIALIZED (
  SELECT a.frame_id, a.y, a.x, b.y AS qy, b.x AS qx FROM wp a JOIN wp b
    ON b.frame_id = a.frame_id AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2 AND (b.z, -b.y, -b.x) >= (a.z, -a.y, -a.x)),
wp_state(k, frame_id, y, x, kept) AS (
  SELECT 0, frame_id, y, x, NULL::BOOLEAN FROM wp
  UNION ALL
  SELECT s.k + 1, n.frame_id, n.y, n.x,
         CASE WHEN bool_or(s.kept) FILTER (n.qy <> n.y OR n.qx <> n.x) THEN FALSE
              WHEN count(*) FILTER (n.qy <> n.y OR n.qx <> n.x) = count(*) FILTER ((n.qy <> n.y OR n.qx <> n.x) AND NOT s.kept) THEN TRUE END
  FROM wp_state s JOIN wp_near n ON n.frame_id = s.frame_id AND n.qy = s.y AND n.qx = s.x WHERE s.k < 40
  GROUP BY s.k, n.frame_id, n.y, n.x),
wmark AS (
  SELECT frame_id, y, x, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY z DESC, y, x) AS INTEGER) AS marker
  FROM wp_state JOIN wp USING (frame_id, y, x) WHERE k = 40 AND kept),
wpx AS MATERIALIZED (
  SELECT f.frame_id, f.y, f.x, -f.z AS d, coalesce(m.marker, 0) AS marker FROM field f LEFT JOIN wmark m USING (frame_id, y, x) WHERE f.z > 0.2),
wedge AS MATERIALIZED (
  SELECT a.frame_id, a.y, a.x, a.d, a.marker, b.y AS qy, b.x AS qx, a.y = b.y AND a.x = b.x AS own
  FROM wpx a JOIN wpx b ON b.frame_id = a.frame_id AND abs(b.y - a.y) + abs(b.x - a.x) <= 1),
wkey(k, frame_id, y, x, key) AS (
  SELECT 0, frame_id, y, x, CASE WHEN marker > 0 THEN [{'d': d, 'n': 0}] END FROM wpx
  UNION ALL
  SELECT s.k + 1, e.frame_id, e.y, e.x,
         min(CASE WHEN e.own THEN s.key WHEN e.marker > 0 OR s.key IS NULL THEN NULL
                  ELSE list_append(list_filter(s.key, lambda p: p.d > e.d),
                                   {'d': e.d, 'n': coalesce(list_max([p.n + 1 FOR p IN s.key IF p.d = e.d]), 0)}) END)
  FROM wkey s JOIN wedge e ON e.frame_id = s.frame_id AND e.qy = s.y AND e.qx = s.x WHERE s.k < 100
  GROUP BY s.k, e.frame_id, e.y, e.x),
worder AS MATERIALIZED (
  SELECT frame_id, y, x, row_number() OVER (PARTITION BY frame_id ORDER BY key, y, x) AS turn FROM wkey WHERE k = 100 AND key IS NOT NULL),
wbefore AS MATERIALIZED (
  SELECT e.frame_id, e.y, e.x, e.marker, e.qy, e.qx, e.own FROM wedge e
  JOIN worder a ON a.frame_id = e.frame_id AND a.y = e.y AND a.x = e.x
  JOIN worder b ON b.frame_id = e.frame_id AND b.y = e.qy AND b.x = e.qx WHERE b.turn <= a.turn),
wlabel(k, frame_id, y, x, id) AS (
  SELECT 0, frame_id, y, x, 0 FROM worder
  UNION ALL
  SELECT s.k + 1, e.frame_id, e.y, e.x,
         CASE WHEN any_value(e.marker) > 0 THEN any_value(e.marker)
              WHEN count(DISTINCT s.id) FILTER (NOT e.own AND s.id > 0) = 1 THEN max(s.id) FILTER (NOT e.own) ELSE 0 END
  FROM wlabel s JOIN wbefore e ON e.frame_id = s.frame_id AND e.qy = s.y AND e.qx = s.x WHERE s.k < 100
  GROUP BY s.k, e.frame_id, e.y, e.x),
watershed AS MATERIALIZED (SELECT frame_id, y, x, id AS object_id FROM wlabel WHERE k = 100 AND id > 0)
""")


@query("watershed_objects", sql.query("watershed", "SELECT * FROM watershed"))
def watershed_objects(spark, sf):
    st = Stages(spark, sf)
    return watershed.watershed(st.field(), st.ws, "z", 2, 0, 0.8, 0.2, (NY, NX))


@query("echo_classes_3d")
def echo_classes_3d(spark, sf):
    return sl3d.classify_volume(
        volume(Stages(spark, sf)), [float(k) for k in range(1, 8)], (NY, NX), 3.5, sl3d.EchoLimits(box_px=2, echo_top_km=6.0)
    )


# -- numbering with a stricter overlap and with time gaps -----------------------------------

sql.fragment("strict_links", ("labels", "pairs"), sql.links_sql("strict_links", "labels", 0.5))
sql.fragment("strict_points", ("strict_links",), sql.points_sql("strict_points", "features", "strict_links"))


@query("track_points_strict", sql.query("strict_points", "SELECT * FROM strict_points"))
def track_points_strict(spark, sf):
    st = Stages(spark, sf)
    links = st.ws.write(link.overlap_links(st.labels(), st.pairs(), 0.5), "strict_links")
    return tracks.number_tracks(st.features(), links, st.pairs(), st.ws, 0.5)


sql.fragment("gap_pairs", ("frames",), """
gap_pairs AS (
  SELECT a.frame_id, b.frame_id AS next_frame FROM frames a JOIN frames b ON b.frame_id = a.frame_id + 1
  WHERE epoch(b.ts) - epoch(a.ts) < 744 * 3600)
""")
sql.fragment("gap_links", ("labels", "gap_pairs"), sql.links_sql("gap_links", "labels", 0.3, pairs="gap_pairs"))
sql.fragment("gap_points", ("gap_links",), sql.points_sql("gap_points", "features", "gap_links", "gap_pairs"))


@query("track_points_gaps", sql.query("gap_points", "SELECT * FROM gap_points"))
def track_points_gaps(spark, sf):
    """Calendar months as times: 31-day steps exceed the gap, so tracks restart."""
    return gap_points(Stages(spark, sf))


def gap_points(st: Stages):
    frames = st.ws.write(tables.frame_table(st.frames().select("ts")), "month_frames")
    pairs = link.frame_pairs(frames, 744.0)
    links = st.ws.write(link.overlap_links(st.labels(), pairs, OTHRESH), "gap_links")
    return tracks.number_tracks(st.features(), links, pairs, st.ws, OTHRESH)


@query("combined_runs", sql.query(("points", "gap_points"), """
SELECT 'even' AS run, * FROM points
UNION ALL
SELECT 'calendar', frame_id, feature_id, track_id + n, track_status, merge_track + n, split_track + n, track_reset
FROM (SELECT frame_id, feature_id, track_id, track_status, merge_track, split_track, track_reset FROM gap_points),
     (SELECT greatest(max(track_id), max(merge_track), max(split_track)) AS n FROM points)"""))
def combined_runs(spark, sf):
    """Two runs over the same features, with even steps and with calendar months, as one table of points."""
    st = Stages(spark, sf)
    runs = {"even": st.points(), "calendar": st.ws.write(gap_points(st), "calendar_points")}
    return combine.combine_runs(runs)
