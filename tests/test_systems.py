from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftfield.operators import mapback, shapes, stats, systems
from driftfield.options import ConvectiveOptions, GenericOptions
from tests.conftest import clock, drawn


def series(spark, tracks):
    rows = [(t, i, (i + 1) * 3600, float(core), float(cold)) for t, areas in tracks.items() for i, (core, cold) in enumerate(areas)]
    return spark.createDataFrame(rows, "track_id long, time_idx int, base_time long, core_area double, cold_area double")


@pytest.mark.parametrize("gap,periods", [(1, 2), (2, 1)])
def test_islands(spark, gap, periods):
    rows = spark.createDataFrame([(1, 0), (1, 2), (1, 3)], "k int, i int")
    assert systems.islands(rows, ["k"], "i", gap).select("island").distinct().count() == periods


def test_cold_systems(spark):
    s = series(
        spark,
        {
            1: [(1, 5), (1, 0), (1, 5), (1, 5)],  # gap of one small time
            2: [(0, 9)] * 6,  # never a core
            3: [(2, 9)] * 2,  # too short
        },
    )
    assert [r.track_id for r in systems.cold_systems(s, 3.0, 4.0, 2, 1.0).collect()] == [1]
    assert systems.cold_systems(s, 3.0, 4.0, 1, 1.0).isEmpty()
    assert systems.cold_systems(s, 3.0, 2.0, 1, 1.0).orderBy("track_id").collect()[0].mcs_duration == 2


PF = "track_id long, time_idx int, pf_majoraxis double, pf_area double, pf_rainrate double, pf_skewness double, total_volrain double, total_heavyvolrain double"


def test_robust_needs_more_candidate_hours_than_the_island(spark):
    ok = (150.0, 900.0, 5.0, 1.0, 100.0, 50.0)
    rows = [(1, t, *ok) for t in range(4)] + [(2, t, *ok) for t in range(5)]
    df = spark.createDataFrame(rows, PF)
    got = systems.robust_by_rain(df, (100, 1800), 4, 1, 1.0, (100, 1), (1, 0.1), (0, 0.01), (3, 0.4))
    assert {r.track_id for r in got.collect()} == {2}
    got = systems.robust_by_rain(df, (100, 1800), 4, 1, 1.0, (100, 1), (1, 0.1), (0, 0.01), (60, 0.4))
    assert got.isEmpty()


def test_life_cycle_stages(spark):
    core = [0, 1, 1, 1, 1, 1, 1, 1, 1, 0]
    axis = [0, 10, 120, 120, 120, 120, 120, 120, 10, 0]
    sf = [0, 0, 0, 0, 0, 0, 50, 50, 0, 0]
    rows = [(1, t, float(core[t]), float(axis[t]), float(sf[t])) for t in range(10)]
    df = spark.createDataFrame(rows, "track_id long, time_idx int, core_area double, core_axis double, sf_area double")
    got = {r.time_idx: (r.cycle_stage, r.cycle_complete) for r in systems.life_cycle(df, 5, 1.0).collect()}
    assert [got[t][0] for t in range(10)] == [1, 2, 2, 3, 3, 3, 4, 4, 5, 5]
    assert {v[1] for v in got.values()} == {1}
    assert systems.life_cycle(df, 11, 1.0).isEmpty()


def test_last_claim_wins_on_pixels(spark):
    rows = [(1, 1, 7, 5, 0, 1, None, None), (1, 1, 7, 9, 0, 2, None, 5)]
    s = spark.createDataFrame(
        rows, "frame_id long, time_idx int, cloudnumber int, track_id long, z int, track_status int, merge_track long, split_track long"
    )
    got = mapback.feature_assignment(s).collect()[0]
    assert (got.tracknumber, got.track_status, got.split_tracknumber) == (9, 2, 5)


def test_unwrapping(spark):
    rows = [(1, i, v) for i, v in enumerate([8.0, 9.5, 0.5, 1.5, 9.8])] + [(2, i, 4.0 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "track_id long, time_idx int, meanlon double")
    got = stats.unwrap_positions(df, {"meanlon": 5.0}, 0.5).orderBy("track_id", "time_idx").collect()
    assert [round(r.meanlon, 6) for r in got] == [8.0, 9.5, 10.5, 11.5, 9.8, 4.0, 5.0, 6.0]
    assert [r.pbc_flag for r in got] == [1] * 5 + [0] * 3


def test_ellipse_and_perimeter_of_a_rectangle(spark):
    px = drawn(spark, [["........", ".444444.", ".444444.", "........"]], digits=True)
    px = px.select("frame_id", "y", "x", F.col("feature_id").cast("long").alias("region"), F.lit(2.0).alias("rain"))
    moments = shapes.region_moments(px, ["frame_id", "region"], "rain")
    row = moments.withColumns(shapes.shape_columns(1.0)).first()
    assert row.majoraxis == pytest.approx(4 * (35 / 12) ** 0.5)
    assert row.minoraxis == pytest.approx(4 * 0.25**0.5)
    assert row.orientation == pytest.approx(90.0)
    assert row.skewness is None or row.skewness != row.skewness
    for tile in (3, 64):
        assert shapes.perimeters(px, ["frame_id"], tile).first().perimeter == pytest.approx(12.0)


def test_options_read_configuration_names():
    opt = ConvectiveOptions.from_config({"cloudtb_core": 220, "mcs_tb_area_thresh": 30000, "timegap": 1.1, "unknown": 1})
    assert (opt.tb_core, opt.system_area, opt.timegap_h) == (220, 30000, 1.1)
    assert GenericOptions.from_config({"field_thresh": [1.6, 1000], "pbc_direction": "x"}).periodic_x


def test_a_feature_across_a_periodic_edge(spark, ws):
    from driftfield.plans.generic import run_generic

    columns = {1: (16, 17, 18), 2: (17, 18, 19), 3: (18, 19, 0), 4: (19, 0, 1), 5: (0, 1, 2), 6: (1, 2, 3)}
    rows = [(f, y, x, 5.0) for f, xs in columns.items() for y in (2, 3) for x in xs]
    field = spark.createDataFrame(rows, "frame_id long, y int, x int, value double")
    cells = [(y, x, float(y), 18.0 * x, 1.0) for y in range(6) for x in range(20)]
    grid = spark.createDataFrame(cells, "y int, x int, lat double, lon double, area_km2 double")
    opt = GenericOptions(
        shape=(6, 20), periodic="x", field_range=(1.0, 9.0), min_npix=1, main_hours=1, main_area=1.0, drop_short=False
    )
    result = run_generic(field, grid, clock(spark, [1, 2, 3, 4, 5, 6]), ws, opt)
    series = result.tracks.series.orderBy("time_idx").collect()
    assert len({r.track_id for r in series}) == 1 and len(series) == 6
    assert all(r.pbc_flag == 1 for r in series)
    steps = [b.meanlon - a.meanlon for a, b in zip(series, series[1:])]
    assert all(0 <= s < 60 for s in steps) and series[-1].meanlon > 342
