"""Motion of features and tiles, trajectory repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as sql
from catalog.registry import query
from catalog.stages import NX, NY, PIXEL_KM, STEP_S, Stages, rounded
from driftfield.operators import link, mapback, motion, smooth

MOVES = "movement_distance movement_distance_x movement_distance_y movement_theta movement_speed"

sql.fragment("feature_motion", ("pixel_tracks", "pairs"), """
mp AS MATERIALIZED (
  SELECT p.cloudtracknumber AS track_id, p.frame_id, p.y, p.x, f.rain AS v
  FROM pixel_tracks p JOIN field f USING (frame_id, y, x) WHERE p.cloudtracknumber > 0),
mboth AS MATERIALIZED (
  SELECT m.track_id, m.frame_id, 0 AS side, y, x, v FROM mp m JOIN pairs p USING (frame_id)
  UNION ALL SELECT m.track_id, p.frame_id, 1, y, x, v FROM mp m JOIN pairs p ON p.next_frame = m.frame_id),
mbox AS MATERIALIZED (
  SELECT track_id, frame_id, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w
  FROM mboth GROUP BY 1, 2 HAVING least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) >= 3),
mcorr AS MATERIALIZED (
  SELECT a.track_id, a.frame_id, b.y - a.y AS dy, b.x - a.x AS dx, sum(a.v * b.v) AS c
  FROM mboth a JOIN mbox USING (track_id, frame_id)
  JOIN mboth b ON b.track_id = a.track_id AND b.frame_id = a.frame_id AND b.side = 1
  WHERE a.side = 0 GROUP BY 1, 2, 3, 4),
mgrid AS (
  SELECT track_id, frame_id, h, w, dy, unnest(range(w // 2 - w + 1, w // 2 + 1)) AS dx
  FROM (SELECT *, unnest(range(h // 2 - h + 1, h // 2 + 1)) AS dy FROM mbox)),
mfull AS MATERIALIZED (
  SELECT g.*, round(coalesce(c, 0), 8) AS c FROM mgrid g LEFT JOIN mcorr USING (track_id, frame_id, dy, dx)),
mbest AS (
  SELECT track_id, frame_id, any_value(h) // 2 - round_even(avg(h // 2 - dy), 0) AS move_y,
         any_value(w) // 2 - round_even(avg(w // 2 - dx), 0) AS move_x
  FROM mfull JOIN (SELECT track_id, frame_id, quantile_cont(c, 0.995) AS q FROM mfull GROUP BY 1, 2) USING (track_id, frame_id)
  WHERE c > q GROUP BY 1, 2),
feature_motion AS MATERIALIZED (
  SELECT track_id, frame_id, move_y, move_x, sqrt(move_x * move_x + move_y * move_y) * 11 AS movement_distance,
         move_x * 11 AS movement_distance_x, move_y * 11 AS movement_distance_y,
         CASE WHEN move_x = 0 AND move_y = 0 THEN NULL
              WHEN 90 - degrees(atan2(move_y, move_x)) < 0 THEN 450 - degrees(atan2(move_y, move_x))
              ELSE 90 - degrees(atan2(move_y, move_x)) END AS movement_theta,
         sqrt(move_x * move_x + move_y * move_y) * 11000 / 3600 AS movement_speed
  FROM mbest)
""")


def moves(st: Stages):
    def build():
        mapped = mapback.map_tracks(st.labels(), st.assignment())
        px = mapped.where("cloudtracknumber > 0").select(
            F.col("cloudtracknumber").alias("track_id"), "frame_id", "y", "x", F.col("rain").alias("value")
        )
        return motion.feature_motion(px, st.pairs(), st.ws, 3, PIXEL_KM)

    return st.keep("moves", build)


@query("feature_motion", sql.query("feature_motion", f"SELECT track_id, frame_id, move_y, move_x, {sql.rnd(MOVES)} FROM feature_motion"))
def feature_motion(spark, sf):
    return rounded(moves(Stages(spark, sf)))


def _aligned(st: Stages):
    clock = st.system_series().select("track_id", "frame_id", "time_idx")
    return clock.join(moves(st), ["track_id", "frame_id"], "left")


@query("movement_by_track_time", sql.query(("feature_motion", "system_series"), f"""
SELECT s.track_id, s.time_idx, {sql.rnd(MOVES)} FROM system_series s LEFT JOIN feature_motion m USING (track_id, frame_id)"""))
def movement_by_track_time(spark, sf):
    return rounded(_aligned(Stages(spark, sf)).select("track_id", "time_idx", *MOVES.split()))


@query("filtered_speed")
def filtered_speed(spark, sf):
    return rounded(motion.filter_speed(_aligned(Stages(spark, sf)), 8.0))


def _advection_sql(name: str, width: int, tag: str) -> str:
    """Motion of the whole field in tiles of ``width`` columns."""
    return f"""
ap{tag} AS MATERIALIZED (
  SELECT frame_id, 0 AS tile_y, x // {width} AS tile_x, y, x, v AS f FROM field
  WHERE v > 0 AND y BETWEEN 1 AND 18 AND x % {width} BETWEEN 1 AND {width} - 2),
aboth{tag} AS MATERIALIZED (
  SELECT a.frame_id, 0 AS side, tile_y, tile_x, y, x, f FROM ap{tag} a JOIN pairs p USING (frame_id)
  UNION ALL SELECT p.frame_id, 1, tile_y, tile_x, y, x, f FROM ap{tag} a JOIN pairs p ON p.next_frame = a.frame_id),
abox{tag} AS (
  SELECT frame_id, tile_y, tile_x, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM aboth{tag} GROUP BY 1, 2, 3),
agrid{tag} AS (
  SELECT *, unnest(range(1 - w, w)) AS dx FROM (SELECT *, unnest(range(1 - h, h)) AS dy FROM abox{tag})),
ahit{tag} AS MATERIALIZED (
  SELECT a.frame_id, a.tile_y, a.tile_x, b.y - a.y AS dy, b.x - a.x AS dx, count(*) AS n,
         sum(a.f) AS s1, sum(b.f) AS s2, sum(a.f * a.f) AS q1, sum(b.f * b.f) AS q2, sum(a.f * b.f) AS p
  FROM aboth{tag} a JOIN aboth{tag} b ON b.frame_id = a.frame_id AND b.tile_x = a.tile_x AND b.side = 1
  WHERE a.side = 0 GROUP BY 1, 2, 3, 4, 5),
ac{tag} AS (
  SELECT frame_id, tile_y, tile_x, dy, dx, coalesce(n, 0) AS n, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2,
         coalesce(q1, 0) AS q1, coalesce(q2, 0) AS q2, coalesce(p, 0) AS p
  FROM agrid{tag} LEFT JOIN ahit{tag} USING (frame_id, tile_y, tile_x, dy, dx)),
ad{tag} AS MATERIALIZED (
  SELECT *, p - s1 * s2 / greatest(n, 1e-12) AS top, sqrt(greatest(q1 - s1 * s1 / greatest(n, 1e-12), 0) * greatest(q2 - s2 * s2 / greatest(n, 1e-12), 0)) AS den FROM ac{tag}),
ascore{tag} AS MATERIALIZED (
  SELECT *, CASE WHEN n >= 0.7 * mn AND den > greatest(md * 1e-9, 1e-6) THEN greatest(least(top / den, 1), -1) ELSE 0 END AS score
  FROM (SELECT *, max(n) OVER w AS mn, max(den) OVER w AS md FROM ad{tag} WINDOW w AS (PARTITION BY frame_id, tile_y, tile_x))),
{name} AS MATERIALIZED (
  SELECT frame_id, tile_y, tile_x, CASE WHEN slow THEN my ELSE 0 END AS y, CASE WHEN slow THEN mx ELSE 0 END AS x
  FROM (SELECT *, sqrt(my * my + mx * mx) * 11000 / 3600 <= 20 AS slow FROM (
    SELECT frame_id, tile_y, tile_x, avg(dy) AS my, avg(dx) AS mx
    FROM (SELECT *, max(score) OVER (PARTITION BY frame_id, tile_y, tile_x) AS best FROM ascore{tag})
    WHERE abs(score - best) <= abs(best) * 1e-5 + 1e-8 GROUP BY 1, 2, 3)))
"""


sql.fragment("advection", ("field", "pairs"), _advection_sql("advection", NX // 2, ""))
sql.fragment("domain_advection", ("field", "pairs"), _advection_sql("domain_advection", NX, "_d"))


def advection(st: Stages, tiles: tuple[int, int] = (1, 2)):
    px = st.field().select("frame_id", "y", "x", F.col("v").alias("value"))
    return motion.tile_advection(px, st.pairs(), st.ws, (NY, NX), tiles, 1, 0.0, PIXEL_KM, PIXEL_KM, STEP_S, 20.0)


def domain_drift(st: Stages):
    """(frame_id, dy, dx): motion of the field as a whole, smoothed in time."""
    raw = st.keep("domain_advection", lambda: advection(st, (1, 1)))
    moves = motion.smooth_advection(raw, PIXEL_KM, PIXEL_KM, STEP_S, 5)
    return moves.select("frame_id", F.col("y").cast("int").alias("dy"), F.col("x").cast("int").alias("dx"))


@query("tile_advection", sql.query("advection", f"SELECT frame_id, tile_y, tile_x, {sql.rnd('y x', 6)} FROM advection"))
def tile_advection(spark, sf):
    st = Stages(spark, sf)
    return rounded(st.keep("advection", lambda: advection(st)), 6)


def _drift_sql(name: str, source: str, tag: str) -> str:
    """Whole grid steps from the running median of the motion."""
    return f"""
amag{tag} AS (SELECT *, sqrt(x * x + y * y) * 11 AS m, 90 - degrees(atan2(y, x)) AS a FROM {source}),
awin{tag} AS (
  SELECT frame_id, tile_y, tile_x, list(m) OVER w AS lm, list(a) OVER w AS la FROM amag{tag}
  WINDOW w AS (PARTITION BY tile_y, tile_x ORDER BY frame_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
amed{tag} AS (
  SELECT frame_id, tile_y, tile_x,
         list_sort(list_resize(lm, 5, 0.0))[3] AS magnitude,
         list_sort(list_resize(la, 5, 0.0))[3] AS direction
  FROM awin{tag}),
{name} AS MATERIALIZED (
  SELECT *, round_even(round(magnitude * cos(radians(90 - direction)) / 11, 9), 0) AS x,
         round_even(round(magnitude * sin(radians(90 - direction)) / 11, 9), 0) AS y FROM amed{tag})
"""


sql.fragment("drift", ("advection",), _drift_sql("drift", "advection", ""))
sql.fragment("domain_drift", ("domain_advection",), _drift_sql("domain_drift", "domain_advection", "_d"))


@query("drift_series", sql.query("drift", f"SELECT frame_id, tile_y, tile_x, x + 0.0::DOUBLE AS x, y + 0.0::DOUBLE AS y, {sql.rnd('magnitude direction', 6)} FROM drift"))
def drift_series(spark, sf):
    st = Stages(spark, sf)
    raw = st.keep("advection", lambda: advection(st))
    return rounded(motion.smooth_advection(raw, PIXEL_KM, PIXEL_KM, STEP_S, 5).drop("speed"), 6)


sql.fragment("drift_links", ("labels", "pairs", "domain_drift"), f"""
drift_table AS (SELECT frame_id, CAST(y AS INTEGER) AS dy, CAST(x AS INTEGER) AS dx FROM domain_drift),
moved AS MATERIALIZED (
  SELECT * FROM (SELECT l.frame_id, l.y + coalesce(dy, 0) AS y, l.x + coalesce(dx, 0) AS x, feature_id
                 FROM labels l LEFT JOIN drift_table USING (frame_id))
  WHERE y BETWEEN 0 AND 19 AND x BETWEEN 0 AND 19),
{sql.links_sql('drift_links', 'labels', 0.3, 'moved').strip()}
""")


@query("link_overlap_drift", sql.query("drift_links", "SELECT * FROM drift_links"))
def link_overlap_drift(spark, sf):
    st = Stages(spark, sf)
    return link.overlap_links(st.labels(), st.pairs(), 0.3, domain_drift(st), (NY, NX))


sql.fragment("smooth_trajectory", ("system_series",), """
pt AS MATERIALIZED (SELECT track_id, time_idx AS i, meanlon, meanlat, area FROM system_series),
scan AS (
  SELECT track_id, s, i, i AS li, meanlon AS lo, meanlat AS la, TRUE AS ok FROM pt, range(3) r(s) WHERE i = s
  UNION ALL
  SELECT track_id, s, i, CASE WHEN fine THEN i ELSE li END, CASE WHEN fine THEN meanlon ELSE lo END,
         CASE WHEN fine THEN meanlat ELSE la END, fine
  FROM (SELECT c.track_id, c.s, p.i, c.li, c.lo, c.la, p.meanlon, p.meanlat,
               2 * 6371 * asin(sqrt(pow(sin(radians(p.meanlat - c.la) / 2), 2) + cos(radians(c.la)) * cos(radians(p.meanlat))
                 * pow(sin(radians(p.meanlon - c.lo) / 2), 2))) / (p.i - c.li) <= 12 AS fine
        FROM scan c JOIN pt p ON p.track_id = c.track_id AND p.i = c.i + 1)),
pick AS (
  SELECT track_id, arg_min(s, bad * 10 + s) AS s FROM (SELECT track_id, s, count(*) FILTER (NOT ok) AS bad FROM scan GROUP BY 1, 2) GROUP BY 1),
mark AS (
  SELECT p.*, coalesce(c.ok, FALSE) AS ok FROM pt p JOIN pick USING (track_id) LEFT JOIN scan c ON c.track_id = p.track_id AND c.s = pick.s AND c.i = p.i),
near AS (
  SELECT *, max(CASE WHEN ok THEN i END) OVER (PARTITION BY track_id ORDER BY i) AS a,
         min(CASE WHEN ok THEN i END) OVER (PARTITION BY track_id ORDER BY i DESC) AS b FROM mark),
fixed AS MATERIALIZED (
  SELECT n.track_id, n.i, n.meanlon, n.meanlat, n.area,
         CASE WHEN n.ok OR ((n.a IS NULL OR n.b IS NULL) AND n.i < 2) THEN n.meanlon ELSE p.meanlon + (q.meanlon - p.meanlon) * (n.i - n.a) / (n.b - n.a) END AS sx,
         CASE WHEN n.ok OR ((n.a IS NULL OR n.b IS NULL) AND n.i < 2) THEN n.meanlat ELSE p.meanlat + (q.meanlat - p.meanlat) * (n.i - n.a) / (n.b - n.a) END AS sy
  FROM near n LEFT JOIN pt p ON p.track_id = n.track_id AND p.i = n.a LEFT JOIN pt q ON q.track_id = n.track_id AND q.i = n.b),
still AS (
  SELECT *, coalesce(sx = meanlon AND sy = meanlat, FALSE) AS same FROM fixed),
around AS (
  SELECT *, max(CASE WHEN same THEN i END) OVER (PARTITION BY track_id ORDER BY i) AS a,
         min(CASE WHEN same THEN i END) OVER (PARTITION BY track_id ORDER BY i DESC) AS b FROM still)
""")


@query("smooth_trajectory", sql.query("smooth_trajectory", f"""
SELECT track_id, time_idx, {sql.rnd('meanlon meanlat area meanlon_smooth meanlat_smooth area_smooth')} FROM (
  SELECT n.track_id, n.i AS time_idx, n.meanlon, n.meanlat, n.area, n.sx AS meanlon_smooth, n.sy AS meanlat_smooth,
         CASE WHEN n.same OR n.a IS NULL OR n.b IS NULL THEN n.area ELSE p.area + (q.area - p.area) * (n.i - n.a) / (n.b - n.a) END AS area_smooth
  FROM around n LEFT JOIN pt p ON p.track_id = n.track_id AND p.i = n.a LEFT JOIN pt q ON q.track_id = n.track_id AND q.i = n.b)"""))
def smooth_trajectory(spark, sf):
    rows = Stages(spark, sf).system_series().select("track_id", "time_idx", "meanlon", "meanlat", "area")
    return rounded(smooth.smooth_tracks(rows, max_kmh=12.0, values=("area",)))
