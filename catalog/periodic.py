"""Identification and rain features on a domain whose edges meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as sql
from catalog.clouds import TB
from catalog.registry import query
from catalog.stages import NX, NY, PIXEL_KM, Stages, rounded
from driftfield.operators import clouds, image, precip
from driftfield.operators.tiles import Wrap

BOTH = Wrap((NY, NX), True, True)
#: Tiles smaller than the grid, so that halos and edges both matter.
TILE = 8
EDGES = f" OR (a.y = b.y AND abs(a.x - b.x) = {NX - 1}) OR (a.x = b.x AND abs(a.y - b.y) = {NY - 1})"


def _apart(axis: str, a: str, b: str) -> str:
    """Steps between two positions on a circle of the grid's size."""
    n = NY if axis == "y" else NX
    return f"least(abs({a}.{axis} - {b}.{axis}), {n} - abs({a}.{axis} - {b}.{axis}))"


@query("smooth_field_periodic", sql.query("field", f"""
SELECT a.frame_id, a.y, a.x, round(avg(b.z), 11) AS smooth FROM field a
JOIN field b ON b.frame_id = a.frame_id AND {_apart('y', 'a', 'b')} <= 2 AND {_apart('x', 'a', 'b')} <= 2
WHERE a.z IS NOT NULL GROUP BY 1, 2, 3"""))
def smooth_field_periodic(spark, sf):
    st = Stages(spark, sf)
    px = st.field().select("frame_id", "y", "x", "z")
    out = image.smooth_box(px, "z", 5, (NY, NX), tile=TILE, wrap=BOTH)
    return rounded(out.select("frame_id", "y", "x", "smooth"), 11)


sql.fragment("periodic_cold", ("field",), sql.regions_sql("periodic_cold", "field", "tb < 241", EDGES))
sql.fragment("periodic_spread", ("periodic_cold", "grid"), f"""
pspread0 AS MATERIALIZED (
  SELECT f.frame_id, f.y, f.x, f.tb, coalesce(k.n, 0) AS n FROM field f
  LEFT JOIN (SELECT r.frame_id, r.y, r.x, s.n FROM periodic_cold r JOIN (
      SELECT frame_id, region, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY c DESC, region DESC) AS INTEGER) AS n
      FROM (SELECT frame_id, region, count(*) AS c FROM periodic_cold JOIN grid USING (y, x) GROUP BY 1, 2 HAVING sum(area_km2) > 300)) s
    USING (frame_id, region)) k USING (frame_id, y, x)),
pspread_step AS (
  SELECT frame_id, y, x, n, 0 AS ring FROM pspread0 WHERE n > 0
  UNION
  SELECT o.frame_id, o.y, o.x, s.n, s.ring + 1 FROM pspread_step s JOIN pspread0 o
    ON o.frame_id = s.frame_id AND {_apart('y', 'o', 's')} + {_apart('x', 'o', 's')} = 1
  WHERE o.n = 0 AND o.tb < 261 AND s.ring < 40),
periodic_spread AS MATERIALIZED (
  SELECT f.frame_id, f.y, f.x, f.n AS convcold_cloudnumber, coalesce(s.n, 0) AS cloudnumber FROM pspread0 f
  LEFT JOIN (SELECT frame_id, y, x, arg_min(n, ring * 100000 + n) AS n FROM pspread_step GROUP BY 1, 2, 3) s USING (frame_id, y, x))
""")


@query("detect_and_spread_periodic", sql.query("periodic_spread", "SELECT frame_id, y, x, convcold_cloudnumber, cloudnumber FROM periodic_spread"))
def detect_and_spread_periodic(spark, sf):
    """Cold areas and their warm surroundings, all across the edges."""
    st = Stages(spark, sf)
    px = st.field().select("frame_id", "y", "x", "tb").join(st.grid().select("y", "x", "area_km2"), ["y", "x"])
    out = clouds.detect_and_spread(px, st.ws, TB, 300.0, (NY, NX), tile=TILE, wrap=BOTH)
    return out.select("frame_id", "y", "x", "convcold_cloudnumber", "cloudnumber")


def _rolled(axis: str, n: int) -> str:
    """SQL of each region's shift along an axis: behind its widest gap, where it touches both edges."""
    return f"""
pr_{axis} AS (
  SELECT frame_id, region, CASE WHEN count(*) FILTER ({axis} = 0) > 0 AND count(*) FILTER ({axis} = {n - 1}) > 0 AND max(gap) > 1
                                THEN {n} - arg_max(nxt, gap * 1000 - {axis}) ELSE 0 END AS shift_{axis}
  FROM (SELECT *, nxt - {axis} AS gap FROM (
    SELECT frame_id, region, {axis}, lead({axis}) OVER (PARTITION BY frame_id, region ORDER BY {axis}) AS nxt
    FROM (SELECT DISTINCT frame_id, region, {axis} FROM pr_px))) GROUP BY 1, 2)"""


sql.fragment("periodic_wet", ("field",), sql.regions_sql("periodic_wet", "field", "rain > 4", EDGES))
sql.fragment("periodic_rain", ("periodic_wet", "grid"), f"""
pr_rank AS MATERIALIZED (
  SELECT frame_id, region, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, region DESC) AS pf_rank
  FROM (SELECT frame_id, region, count(*) AS n FROM periodic_wet GROUP BY 1, 2 HAVING count(*) > 1)),
pr_px AS MATERIALIZED (
  SELECT w.frame_id, w.y, w.x, w.region, k.pf_rank, f.rain, g.area_km2 FROM periodic_wet w
  JOIN pr_rank k USING (frame_id, region) JOIN field f USING (frame_id, y, x) JOIN grid g USING (y, x)),
pr_near AS MATERIALIZED (
  SELECT a.frame_id, a.region, a.y, a.x, count(*) FILTER ({_apart('y', 'a', 'b')} + {_apart('x', 'a', 'b')} = 1) AS sides
  FROM pr_px a JOIN pr_px b USING (frame_id, region)
  WHERE {_apart('y', 'a', 'b')} <= 1 AND {_apart('x', 'a', 'b')} <= 1 GROUP BY ALL),
pr_code AS (
  SELECT a.frame_id, a.region, a.y, a.x,
         sum(CASE {_apart('y', 'a', 'b')} + {_apart('x', 'a', 'b')} WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS code
  FROM pr_near a JOIN pr_near b USING (frame_id, region)
  WHERE a.sides < 4 AND b.sides < 4 AND {_apart('y', 'a', 'b')} <= 1 AND {_apart('x', 'a', 'b')} <= 1 GROUP BY ALL),
pr_length AS (
  SELECT frame_id, region,
         sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1.0::DOUBLE WHEN code IN (21, 33) THEN sqrt(2)
                  WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS len
  FROM pr_code GROUP BY 1, 2),
{_rolled('y', NY).strip()},
{_rolled('x', NX).strip()},
pr_moment AS (
  SELECT frame_id, region, pf_rank, count(*) AS pf_npix, sum(area_km2) AS pf_area, sum(rain) AS pf_accumrain,
         any_value(shift_y) AS shift_y, any_value(shift_x) AS shift_x, avg(v) AS my, avg(u) AS mx,
         var_pop(u) AS vx, var_pop(v) AS vy, covar_pop(u, v) AS c
  FROM (SELECT *, (y + shift_y) % {NY} AS v, (x + shift_x) % {NX} AS u FROM pr_px JOIN pr_y USING (frame_id, region) JOIN pr_x USING (frame_id, region))
  GROUP BY 1, 2, 3),
periodic_rain AS MATERIALIZED (
  SELECT frame_id, pf_rank, pf_npix, pf_area, pf_accumrain,
         4 * sqrt((vx + vy) / 2 + sqrt(((vx - vy) / 2) * ((vx - vy) / 2) + c * c)) * 11.0::DOUBLE AS pf_majoraxis, coalesce(len, 0) * 11.0::DOUBLE AS pf_perimeter,
         (round_even(my, 0) - shift_y + {NY}) % {NY} AS cy, (round_even(mx, 0) - shift_x + {NX}) % {NX} AS cx
  FROM pr_moment LEFT JOIN pr_length USING (frame_id, region))
""")


@query("rain_features_periodic", sql.query("periodic_rain", f"""
SELECT frame_id, pf_rank, pf_npix, {sql.rnd('pf_area pf_accumrain pf_majoraxis pf_perimeter', 6)},
       cy + 0.0::DOUBLE AS cy, cx + 0.0::DOUBLE AS cx FROM periodic_rain"""))
def rain_features_periodic(spark, sf):
    """Rain features of whole frames, in one piece where they lie across an edge."""
    st = Stages(spark, sf)
    px = st.field().select("frame_id", "y", "x", "rain").join(st.grid().select("y", "x", "lat", "lon", "area_km2"), ["y", "x"])
    px = px.withColumns({"track_id": F.lit(1).cast("long"), "time_idx": F.lit(0)})
    feats, _ = precip.rain_features(px, st.ws, 4.0, 6.0, 100.0, PIXEL_KM, shape=(NY, NX), tile=TILE, wrap=BOTH)
    out = feats.select(
        "frame_id", "pf_rank", "pf_npix", "pf_area", "pf_accumrain", "pf_majoraxis", "pf_perimeter",
        *[F.col(f"_{c}").alias(c) for c in ("cy", "cx")],
    )
    return rounded(out, 6)
