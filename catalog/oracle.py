"""SQL text for the side-by-side check, written independently of the Spark plans.

Each fragment is one or more common table expressions; ``query`` strings them
together in dependency order.
"""

from __future__ import annotations

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def fragment(name: str, needs: tuple[str, ...], sql: str) -> None:
    FRAGMENTS[name] = (needs, sql.strip())


def query(needs: tuple[str, ...] | str, select: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in FRAGMENTS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in (needs,) if isinstance(needs, str) else needs:
        visit(name)
    if not ordered:
        return f"WITH {select.strip()}"
    ctes = ",\n".join(FRAGMENTS[n][1] for n in ordered)
    return f"WITH RECURSIVE {ctes}\n{select.strip()}"


fragment("raw_field", (), """
monthly AS (
  SELECT date_trunc('month', l_shipdate) AS ts,
         CAST((l_partkey // 20) % 20 AS INTEGER) AS y,
         CAST(l_partkey % 20 AS INTEGER) AS x,
         sum(l_quantity) AS v, sum(round(l_discount * 100)) AS d
  FROM lineitem GROUP BY 1, 2, 3),
raw_field AS (
  SELECT ts + to_months(CAST(k AS INTEGER)) AS ts, y, x, sum(v) AS v, sum(d) AS d
  FROM monthly, range(4) r(k) GROUP BY 1, 2, 3)
""")

fragment("frames", ("raw_field",), """
frames AS (
  SELECT ts, row_number() OVER (ORDER BY ts) AS frame_id,
         3600 * row_number() OVER (ORDER BY ts) AS epoch_s
  FROM (SELECT DISTINCT ts FROM raw_field WHERE ts IS NOT NULL))
""")

fragment("field", ("frames",), """
zfield AS (
  SELECT f.frame_id, r.y, r.x, r.v, r.d,
         avg(r.v) OVER w AS mv, stddev_pop(r.v) OVER w AS sv,
         avg(r.d) OVER w AS md, stddev_pop(r.d) OVER w AS sd
  FROM raw_field r JOIN frames f USING (ts)
  WINDOW w AS (PARTITION BY f.frame_id)),
field AS (
  SELECT frame_id, y, x, v,
         round(CASE WHEN sv > 0 THEN (v - mv) / sv ELSE 0 END, 6) AS z,
         round(250.0::DOUBLE - (CASE WHEN sv > 0 THEN (v - mv) / sv ELSE 0 END) * 15.0::DOUBLE, 4) AS tb,
         round(greatest((CASE WHEN sd > 0 THEN (d - md) / sd ELSE 0 END) * 4.0::DOUBLE + 3.0::DOUBLE, 0), 4) AS rain
  FROM zfield)
""")

fragment("grid", (), """
grid AS (
  SELECT y, x, lat, lon, landfrac,
         6371.0::DOUBLE * radians(0.1::DOUBLE)
         * 2 * 6371.0::DOUBLE * asin(cos(radians(lat)) * sin(radians(0.1::DOUBLE) / 2)) AS area_km2
  FROM (SELECT CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x,
               (a.y - 10) / 10.0::DOUBLE AS lat, (b.x + 200) / 10.0::DOUBLE AS lon,
               CASE WHEN b.x < 10 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS landfrac
        FROM range(20) a(y), range(20) b(x)))
""")


def rnd(columns: str, digits: int = 9, **special: int) -> str:
    """Select list of rounded columns (areas and volumes to six places at most)."""

    def places(c: str) -> int:
        return special.get(c, min(digits, 6) if "area" in c or "vol" in c else digits)

    return ", ".join(f"round({c}, {places(c)}) + 0.0::DOUBLE AS {c}" for c in columns.split())


def regions_sql(name: str, source: str, where: str, wrap: str = "") -> str:
    """4-connected regions of ``source`` rows satisfying ``where`` as recursive flooding."""
    return f"""
{name}_px AS MATERIALIZED (
  SELECT frame_id, y, x, CAST(y AS BIGINT) * 4294967296 + x AS p FROM {source} WHERE {where}),
{name}_edge AS MATERIALIZED (
  SELECT a.frame_id, a.p AS p, b.p AS q
  FROM {name}_px a JOIN {name}_px b
    ON a.frame_id = b.frame_id
   AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1){wrap})),
{name}_reach AS (
  SELECT frame_id, p, p AS q FROM {name}_px
  UNION
  SELECT r.frame_id, r.p, e.q FROM {name}_reach r
  JOIN {name}_edge e ON e.frame_id = r.frame_id AND e.p = r.q),
{name} AS MATERIALIZED (
  SELECT px.frame_id, px.y, px.x, m.region
  FROM {name}_px px
  JOIN (SELECT frame_id, p, min(q) AS region FROM {name}_reach GROUP BY 1, 2) m
    ON m.frame_id = px.frame_id AND m.p = px.p)
"""


fragment("regions", ("field",), regions_sql("regions", "field", "tb < 241.0"))

fragment("labels", ("regions",), """
features AS MATERIALIZED (
  SELECT frame_id, region, npix, area,
         CAST(row_number() OVER (PARTITION BY frame_id ORDER BY npix DESC, region DESC) AS INTEGER) AS feature_id
  FROM (SELECT frame_id, region, count(*) AS npix, CAST(count(*) AS DOUBLE) AS area
        FROM regions GROUP BY 1, 2 HAVING count(*) > 1)),
labels AS MATERIALIZED (
  SELECT frame_id, y, x, feature_id FROM regions JOIN features USING (frame_id, region))
""")

fragment("pairs", ("frames",), """
pairs AS (
  SELECT a.frame_id, b.frame_id AS next_frame, (b.epoch_s - a.epoch_s) / 3600.0 AS dt_h
  FROM frames a JOIN frames b ON b.frame_id = a.frame_id + 1
  WHERE b.epoch_s - a.epoch_s > 0 AND (b.epoch_s - a.epoch_s) / 3600.0 < 3.1)
""")


def links_sql(name: str, labels: str, othresh: float, ref_labels: str | None = None, pairs: str = "pairs") -> str:
    ref = ref_labels or labels
    return f"""
{name} AS MATERIALIZED (
  WITH o AS (
    SELECT a.frame_id AS ref_frame, a.feature_id AS ref_id, b.frame_id AS new_frame, b.feature_id AS new_id,
           count(*) AS overlap_px
    FROM {ref} a JOIN {pairs} p ON p.frame_id = a.frame_id
    JOIN {labels} b ON b.frame_id = p.next_frame AND b.y = a.y AND b.x = a.x
    GROUP BY 1, 2, 3, 4),
  rs AS (SELECT frame_id, feature_id, count(*) AS n FROM {ref} GROUP BY 1, 2),
  ns AS (SELECT frame_id, feature_id, count(*) AS n FROM {labels} GROUP BY 1, 2)
  SELECT o.*, rs.n AS ref_px, ns.n AS new_px,
         overlap_px::DOUBLE / rs.n > {othresh} AS is_fwd, overlap_px::DOUBLE / ns.n > {othresh} AS is_bwd
  FROM o JOIN rs ON rs.frame_id = ref_frame AND rs.feature_id = ref_id
  JOIN ns ON ns.frame_id = new_frame AND ns.feature_id = new_id
  WHERE overlap_px::DOUBLE / rs.n > {othresh} OR overlap_px::DOUBLE / ns.n > {othresh})
"""


fragment("links", ("labels", "pairs"), links_sql("links", "labels", 0.3))


def points_sql(p: str, features: str, links: str, pairs: str = "pairs") -> str:
    """Groups by reachability, last group decides, ids in issue order."""
    return f"""
{p}_reach AS (
  SELECT DISTINCT ref_frame, ref_id AS lead, 0 AS side, ref_id AS id FROM {links}
  UNION
  SELECT r.ref_frame, r.lead, 1 - r.side, CASE WHEN r.side = 0 THEN l.new_id ELSE l.ref_id END
  FROM {p}_reach r JOIN {links} l ON l.ref_frame = r.ref_frame
   AND ((r.side = 0 AND l.ref_id = r.id) OR (r.side = 1 AND l.new_id = r.id AND l.is_fwd))),
{p}_member AS MATERIALIZED (
  SELECT m.*, f.npix FROM {p}_reach m
  JOIN {features} f ON f.frame_id = m.ref_frame + m.side AND f.feature_id = m.id
  WHERE NOT EXISTS (SELECT 1 FROM {p}_reach e
    WHERE e.ref_frame = m.ref_frame AND e.side = 0 AND e.id = m.lead AND e.lead < m.lead)),
{p}_group AS MATERIALIZED (
  SELECT ref_frame, lead, count(*) FILTER (side = 0) AS nref, count(*) FILTER (side = 1) AS nnew,
         arg_max(id, npix * 1000000 - id) FILTER (side = 0) AS big_ref,
         arg_max(id, npix * 1000000 - id) FILTER (side = 1) AS big_new
  FROM {p}_member GROUP BY 1, 2),
{p}_ref AS (
  SELECT ref_frame, id AS ref_id,
         arg_max(CASE WHEN nref > 1 AND nnew > 1 THEN (CASE WHEN id = big_ref THEN 15 ELSE 34 END)
                      WHEN nref > 1 THEN (CASE WHEN id = big_ref THEN 2 ELSE 21 END)
                      WHEN nnew > 1 THEN 13 ELSE 1 END, lead) AS ref_status,
         arg_max(big_ref, lead) FILTER (nref > 1 AND id <> big_ref) AS merge_ref
  FROM {p}_member JOIN {p}_group USING (ref_frame, lead) WHERE side = 0 GROUP BY 1, 2),
{p}_new AS (
  SELECT ref_frame + 1 AS frame_id, id AS new_id,
         arg_max(CASE WHEN id = big_new THEN 3 ELSE 31 END, lead) FILTER (nnew > 1) AS new_status,
         arg_max(CASE WHEN id = big_new THEN big_ref ELSE -1 END, lead) AS src,
         max(lead) AS lead,
         arg_max(big_ref, lead) FILTER (id <> big_new) AS split_ref
  FROM {p}_member JOIN {p}_group USING (ref_frame, lead) WHERE side = 1 GROUP BY 1, 2),
{p}_base AS MATERIALIZED (
  SELECT f.frame_id, f.feature_id, coalesce(r.ref_status, 0) + coalesce(n.new_status, 0) AS track_status,
         r.merge_ref, n.split_ref, nullif(n.src, -1) AS src,
         CASE WHEN pr.frame_id IS NULL THEN 0 WHEN n.src = -1 THEN 1 ELSE 2 END AS birth,
         CASE WHEN n.src = -1 THEN n.lead ELSE f.feature_id END AS birth_order,
         pr.frame_id IS NULL AS opens, nx.frame_id IS NULL AS closes
  FROM {features} f
  LEFT JOIN {pairs} nx ON nx.frame_id = f.frame_id
  LEFT JOIN {pairs} pr ON pr.next_frame = f.frame_id
  LEFT JOIN {p}_ref r ON r.ref_frame = f.frame_id AND r.ref_id = f.feature_id
  LEFT JOIN {p}_new n ON n.frame_id = f.frame_id AND n.new_id = f.feature_id
  WHERE nx.frame_id IS NOT NULL OR pr.frame_id IS NOT NULL),
{p}_start AS MATERIALIZED (
  SELECT frame_id, feature_id, row_number() OVER (ORDER BY frame_id, birth, birth_order, feature_id) AS track_id
  FROM {p}_base WHERE src IS NULL),
{p}_walk AS (
  SELECT frame_id, feature_id, track_id FROM {p}_start
  UNION ALL
  SELECT b.frame_id, b.feature_id, w.track_id FROM {p}_walk w
  JOIN {p}_base b ON b.frame_id = w.frame_id + 1 AND b.src = w.feature_id),
{p} AS MATERIALIZED (
  SELECT b.frame_id, b.feature_id, w.track_id, b.track_status,
         m.track_id AS merge_track, s.track_id AS split_track,
         CASE WHEN b.closes THEN 2 WHEN b.opens THEN 1 WHEN b.src IS NULL THEN 0 END AS track_reset
  FROM {p}_base b JOIN {p}_walk w USING (frame_id, feature_id)
  LEFT JOIN {p}_walk m ON m.frame_id = b.frame_id AND m.feature_id = b.merge_ref
  LEFT JOIN {p}_walk s ON s.frame_id = b.frame_id - 1 AND s.feature_id = b.split_ref)
"""


fragment("points", ("links",), points_sql("points", "features", "links"))


fragment("cloud_pixels", ("labels", "grid"), """
cloud_pixels AS MATERIALIZED (
  SELECT l.frame_id, l.y, l.x, l.feature_id, f.tb, f.rain, g.lat, g.lon, g.area_km2, g.landfrac,
         CASE WHEN tb < 225 THEN 1 WHEN tb < 241 THEN 2 WHEN tb < 261 THEN 3 ELSE 5 END AS cloudtype
  FROM labels l JOIN field f USING (frame_id, y, x) JOIN grid g USING (y, x))
""")

fragment("feature_stats", ("cloud_pixels",), """
feature_stats AS MATERIALIZED (
  SELECT frame_id, feature_id, count(*) AS npix, sum(area_km2) AS area, avg(lat) AS meanlat, avg(lon) AS meanlon,
         coalesce(sum(area_km2) FILTER (cloudtype = 1), 0) AS core_area,
         coalesce(sum(area_km2) FILTER (cloudtype = 2), 0) AS cold_area,
         min(tb) AS corecold_mintb, avg(tb) AS corecold_meantb,
         avg(tb) FILTER (cloudtype = 1) AS core_meantb,
         first(lat ORDER BY tb, y, x) AS mintb_lat, first(lon ORDER BY tb, y, x) AS mintb_lon
  FROM cloud_pixels GROUP BY 1, 2)
""")

fragment("all_series", ("points", "feature_stats"), """
all_series AS MATERIALIZED (
  SELECT p.frame_id, p.feature_id AS cloudnumber, p.track_id, p.track_status, p.merge_track, p.split_track,
         p.track_reset, s.* EXCLUDE (frame_id, feature_id), f.epoch_s AS base_time,
         CAST(row_number() OVER (PARTITION BY p.track_id ORDER BY p.frame_id) - 1 AS INTEGER) AS time_idx
  FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame_id ORDER BY feature_id) AS n FROM points) p
  JOIN feature_stats s USING (frame_id, feature_id) JOIN frames f USING (frame_id) WHERE p.n = 1)
""")


def ends_sql(name: str, series: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  WITH b AS (
    SELECT track_id, count(*) AS track_duration,
           arg_min(track_status, time_idx) AS start_status, arg_max(track_status, time_idx) AS end_status,
           min(base_time) AS start_basetime, max(base_time) AS end_basetime,
           arg_min_null(split_track, time_idx) AS start_split_tracknumber,
           arg_max_null(merge_track, time_idx) AS end_merge_tracknumber
    FROM {series} GROUP BY 1)
  SELECT b.*, sp.time_idx - 1 AS start_split_timeindex, sb.cloudnumber AS start_split_cloudnumber,
         mp.time_idx + 1 AS end_merge_timeindex, ma.cloudnumber AS end_merge_cloudnumber
  FROM b
  LEFT JOIN {series} sp ON sp.track_id = b.start_split_tracknumber AND sp.base_time = b.start_basetime AND sp.time_idx > 0
  LEFT JOIN {series} sb ON sb.track_id = sp.track_id AND sb.time_idx = sp.time_idx - 1
  LEFT JOIN {series} mp ON mp.track_id = b.end_merge_tracknumber AND mp.base_time = b.end_basetime
  LEFT JOIN {series} ma ON ma.track_id = mp.track_id AND ma.time_idx = mp.time_idx + 1)
"""


fragment("all_ends", ("all_series",), ends_sql("all_ends", "all_series"))

fragment("series", ("all_ends",), """
kept AS MATERIALIZED (
  SELECT track_id, row_number() OVER (ORDER BY track_id) AS new_id FROM all_ends
  WHERE NOT (track_duration < 2 AND start_split_timeindex IS NULL AND end_merge_timeindex IS NULL)),
series AS MATERIALIZED (
  SELECT s.* REPLACE (k.new_id AS track_id, m.new_id AS merge_track, sp.new_id AS split_track)
  FROM all_series s JOIN kept k USING (track_id)
  LEFT JOIN kept m ON m.track_id = s.merge_track LEFT JOIN kept sp ON sp.track_id = s.split_track)
""")

fragment("ends", ("series",), ends_sql("ends", "series"))

fragment("systems", ("series",), """
candidate AS (
  SELECT track_id, time_idx,
         CASE WHEN time_idx - lag(time_idx) OVER w > 1 THEN 1 ELSE 0 END AS opens
  FROM series WHERE core_area + cold_area > 400
  WINDOW w AS (PARTITION BY track_id ORDER BY time_idx)),
period AS (
  SELECT track_id, island, count(*) AS n, (max(time_idx) - min(time_idx) + 1) * 1.0 AS hours
  FROM (SELECT *, sum(opens) OVER (PARTITION BY track_id ORDER BY time_idx) AS island FROM candidate)
  GROUP BY 1, 2),
systems AS MATERIALIZED (
  SELECT track_id, CAST(sum(n) AS BIGINT) AS mcs_duration FROM period
  WHERE hours >= 3 AND track_id IN (SELECT track_id FROM series WHERE core_area > 0) GROUP BY 1)
""")


def attached_sql(name: str, main: str, area: str, slots: str = "") -> str:
    return f"""
{name} AS MATERIALIZED (
  WITH l AS (
    SELECT end_merge_tracknumber AS main, track_id, 'merge' AS kind FROM ends WHERE track_duration < 12
    UNION ALL
    SELECT start_split_tracknumber, track_id, 'split' FROM ends WHERE track_duration < 12)
  SELECT c.track_id, c.time_idx, c.base_time, l.kind, p.track_id AS part_track, p.cloudnumber,
         p.track_status AS part_status, {area} AS part_area,
         row_number() OVER (PARTITION BY c.track_id, l.kind, c.base_time ORDER BY p.track_id, p.time_idx) AS slot
  FROM l JOIN {main} s ON s.track_id = l.main
  JOIN series p ON p.track_id = l.track_id
  JOIN series c ON c.track_id = l.main AND c.base_time = p.base_time
  WHERE l.track_id NOT IN (SELECT track_id FROM {main}) {slots})
"""


fragment("attached", ("systems", "ends"), attached_sql("attached", "systems", "p.core_area + p.cold_area"))

fragment("system_series", ("systems",), """
system_series AS MATERIALIZED (
  SELECT s.*, y.mcs_duration, core_area + cold_area AS ccs_area,
         CASE WHEN core_area + cold_area > 400 THEN 1 WHEN core_area + cold_area > 0 THEN 0 END AS mcs_status
  FROM series s JOIN systems y USING (track_id))
""")

fragment("system_pixels", ("system_series", "attached", "cloud_pixels"), """
members AS (
  SELECT track_id, frame_id, time_idx, cloudnumber AS feature_id FROM system_series
  UNION
  SELECT a.track_id, s.frame_id, a.time_idx, a.cloudnumber FROM attached a JOIN system_series s USING (track_id, time_idx)),
system_pixels AS MATERIALIZED (
  SELECT c.* EXCLUDE (feature_id), m.track_id, m.time_idx FROM cloud_pixels c JOIN members m USING (frame_id, feature_id))
""")

fragment("rain_totals", ("system_pixels",), """
rain_totals AS MATERIALIZED (
  SELECT track_id, frame_id, time_idx, coalesce(sum(rain), 0) AS total_rain,
         coalesce(sum(rain * area_km2), 0) AS total_volrain,
         sum(rain) FILTER (rain > 6) AS total_heavyrain, sum(rain * area_km2) FILTER (rain > 6) AS total_heavyvolrain,
         avg(rain) FILTER (rain > 6) AS rainrate_heavyrain,
         quantile_cont(rain, 0.95) FILTER (rain > 3) AS rainrate_p95,
         (count(*) FILTER (rain > 3 AND landfrac BETWEEN 90 AND 100))::DOUBLE
         / nullif(count(*) FILTER (rain > 3), 0) AS pf_landfrac
  FROM system_pixels GROUP BY 1, 2, 3)
""")

fragment("rain_features", ("system_pixels",), """
wet AS MATERIALIZED (
  SELECT track_id, frame_id, time_idx, y, x, CAST(y AS BIGINT) * 4294967296 + x AS p, rain, lat, lon, area_km2
  FROM system_pixels WHERE rain > 3),
wet_edge AS MATERIALIZED (
  SELECT a.track_id, a.frame_id, a.p, b.p AS q FROM wet a JOIN wet b USING (track_id, frame_id)
  WHERE abs(a.y - b.y) + abs(a.x - b.x) = 1),
wet_reach AS (
  SELECT track_id, frame_id, p, p AS q FROM wet
  UNION
  SELECT r.track_id, r.frame_id, r.p, e.q FROM wet_reach r
  JOIN wet_edge e ON e.track_id = r.track_id AND e.frame_id = r.frame_id AND e.p = r.q),
wet_region AS MATERIALIZED (
  SELECT w.*, m.region FROM wet w
  JOIN (SELECT track_id, frame_id, p, min(q) AS region FROM wet_reach GROUP BY 1, 2, 3) m USING (track_id, frame_id, p)),
pf_rank AS MATERIALIZED (
  SELECT track_id, frame_id, region, row_number() OVER (PARTITION BY track_id, frame_id ORDER BY n DESC, region DESC) AS pf_rank
  FROM (SELECT track_id, frame_id, region, count(*) AS n FROM wet_region GROUP BY 1, 2, 3 HAVING count(*) > 1)),
pf_px AS MATERIALIZED (
  SELECT w.*, k.pf_rank FROM wet_region w JOIN pf_rank k USING (track_id, frame_id, region)),
pf_near AS MATERIALIZED (
  SELECT a.track_id, a.frame_id, a.region, a.y, a.x,
         count(*) FILTER (abs(b.y - a.y) + abs(b.x - a.x) = 1) AS sides
  FROM pf_px a JOIN pf_px b USING (track_id, frame_id, region)
  WHERE abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY ALL),
pf_code AS (
  SELECT a.track_id, a.frame_id, a.region, a.y, a.x,
         sum(CASE abs(b.y - a.y) + abs(b.x - a.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS code
  FROM pf_near a JOIN pf_near b USING (track_id, frame_id, region)
  WHERE a.sides < 4 AND b.sides < 4 AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY ALL),
pf_length AS (
  SELECT track_id, frame_id, region,
         sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1.0::DOUBLE WHEN code IN (21, 33) THEN sqrt(2)
                  WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS len
  FROM pf_code GROUP BY 1, 2, 3),
pf_moment AS (
  SELECT track_id, frame_id, time_idx, region, pf_rank, count(*) AS pf_npix,
         avg(lon) AS pf_lon, avg(lat) AS pf_lat, sum(area_km2) AS pf_area,
         avg(rain) AS pf_rainrate, max(rain) AS pf_maxrainrate, sum(rain) AS pf_accumrain,
         sum(rain) FILTER (rain > 6) AS pf_accumrainheavy,
         avg(rain) AS m1, var_pop(rain) AS m2, avg(rain * rain * rain) AS r3, avg(rain * rain) AS r2,
         var_pop(x::DOUBLE) AS vx, var_pop(y::DOUBLE) AS vy, covar_pop(x::DOUBLE, y::DOUBLE) AS cxy,
         avg(y) AS my, avg(x) AS mx, sum(rain * y) / sum(rain) AS wy, sum(rain * x) / sum(rain) AS wx
  FROM pf_px GROUP BY 1, 2, 3, 4, 5),
pf_axis AS (
  SELECT *, (vx + vy) / 2 + sqrt(((vx - vy) / 2) ^ 2 + cxy ^ 2) AS l1,
         CASE WHEN (vx + vy) / 2 - sqrt(((vx - vy) / 2) ^ 2 + cxy ^ 2) < 1e-12 THEN 0
              ELSE (vx + vy) / 2 - sqrt(((vx - vy) / 2) ^ 2 + cxy ^ 2) END AS l2
  FROM pf_moment),
pf_peak AS (
  SELECT track_id, frame_id, first(lat ORDER BY rain DESC, y, x) AS pf_lat_maxrainrate,
         first(lon ORDER BY rain DESC, y, x) AS pf_lon_maxrainrate
  FROM system_pixels GROUP BY 1, 2),
rain_features AS MATERIALIZED (
  SELECT a.track_id, a.frame_id, a.time_idx, a.pf_rank, a.pf_npix, pf_lon, pf_lat, pf_area, pf_rainrate,
         pf_maxrainrate, pf_accumrain, pf_accumrainheavy,
         CASE WHEN m2 > 1e-14 THEN (r3 - 3 * m1 * r2 + 2 * m1 * m1 * m1) / (m2 * sqrt(m2)) END AS pf_skewness,
         4 * sqrt(l1) * 11.0::DOUBLE AS pf_majoraxis, 4 * sqrt(l2) * 11.0::DOUBLE AS pf_minoraxis,
         CASE WHEN l2 > 0 THEN sqrt(l1) / sqrt(l2) END AS pf_aspectratio,
         CASE WHEN l1 > 0 THEN sqrt(1 - l2 / l1) ELSE 0 END AS pf_eccentricity,
         degrees(CASE WHEN abs(vx - vy) < 1e-12 THEN (CASE WHEN cxy > 1e-12 THEN pi() / 4 ELSE -pi() / 4 END)
                      ELSE 0.5 * atan2(CASE WHEN abs(cxy) < 1e-12 THEN 0 ELSE 2 * cxy END, vy - vx) END) AS pf_orientation,
         len * 11.0::DOUBLE AS pf_perimeter, pf_lat_maxrainrate, pf_lon_maxrainrate,
         round_even(my, 0) AS cy, round_even(mx, 0) AS cx, round_even(wy, 0) AS hy, round_even(wx, 0) AS hx
  FROM pf_axis a JOIN pf_length USING (track_id, frame_id, region) JOIN pf_peak USING (track_id, frame_id)),
pf_counts AS (SELECT track_id, frame_id, count(*) AS pf_npf FROM pf_rank GROUP BY 1, 2)
""")
