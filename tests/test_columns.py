from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftfield.functions import geo, physics, timeparse
from driftfield.operators import regrid, vertical

SCHEMA = "frame_id long, y int, x int, z int, height_m double, v double"


def column(spark, values, y=0, x=0, dz=1000.0):
    rows = [(1, y, x, z, z * dz, float(v)) for z, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, SCHEMA)


def test_echo_top_of_a_tall_column(spark):
    got = vertical.echo_top(column(spark, [50] * 8 + [5, 5]), "v", 20, 1).collect()
    assert got[0].echotop == 7000.0
    assert vertical.echo_top(column(spark, [5] * 10), "v", 20, 1).isEmpty()


@pytest.mark.parametrize("gap,top", [(1, 1000.0), (2, 3000.0)])
def test_echo_top_gap(spark, gap, top):
    got = vertical.echo_top(column(spark, [30, 30, 5, 30, 5, 5, 5, 30]), "v", 20, gap).collect()
    assert got[0].echotop == top


def test_several_echo_tops_at_once(spark):
    df = column(spark, [45, 35, 25, 15]).unionByName(column(spark, [25, 25, 5, 45], x=1))
    got = {r.x: r for r in vertical.echo_tops(df, "v", (10, 20, 30, 40), 1).collect()}
    assert (got[0].echotop10, got[0].echotop20, got[0].echotop30, got[0].echotop40) == (3000, 2000, 1000, 0)
    assert (got[1].echotop20, got[1].echotop40) == (1000, 3000)


def test_layers(spark):
    got = vertical.echo_layers(column(spark, [30, 30, 5, 30, 30]), "v", 20, 1).orderBy("layer").collect()
    assert [(r.base_m, r.top_m) for r in got] == [(0, 1000), (3000, 4000)]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7])
def test_cold_pool_integral_is_exact_for_parabolas(spark, n):
    h = np.array([0, 90, 200, 340, 500, 700, 930.0])[:n]
    b = -0.02 + 1e-5 * h + 2e-9 * h * h if n > 2 else -0.02 + 1e-5 * h
    rows = [(1, 0, 0, z, float(h[z]), float(b[z])) for z in range(n)]
    got = vertical.cold_pool(spark.createDataFrame(rows, SCHEMA), "v", -0.001, 0.0).collect()[0]
    top = h[-1]
    exact = -0.02 * top + 0.5e-5 * top**2 + (2e-9 / 3 * top**3 if n > 2 else 0)
    assert got.cp_intensity == pytest.approx(math.sqrt(-2 * exact), rel=1e-9)
    assert (got.cp_base, got.cp_top, got.cp_depth) == (0, top, top)


def test_cold_pool_must_touch_the_surface(spark):
    assert vertical.cold_pool(column(spark, [0.0, -0.02, -0.02]), "v", -0.01, 0).isEmpty()
    pools = vertical.cold_pool(column(spark, [-0.02, -0.02, 0.0, -0.02]), "v", -0.01, 0)
    low = spark.createDataFrame([(1, 0, 0, 50.0)], "frame_id long, y int, x int, zz_bot double")
    got = vertical.surface_cold_pools(pools, low).collect()[0]
    assert got.cp_intensity == 0.0 and got.cp_depth is None


def test_melting_height_takes_the_highest_crossing(spark):
    df = column(spark, [5, -5, 5, -15]).withColumnRenamed("v", "temp_c")
    assert vertical.melting_height(df).collect()[0].melting_height == pytest.approx(2250.0)


def test_rate_from_accumulation(spark):
    rows = [(0, 0, 0, 1.0), (0, 0, 1800, 2.0), (0, 0, 5400, 2.0)]
    df = spark.createDataFrame(rows, "y int, x int, epoch_s long, acc double")
    got = [r.rainrate for r in vertical.accumulated_to_rate(df, "acc").orderBy("epoch_s").collect()]
    assert got == [2.0, 0.0]


@pytest.mark.parametrize(
    "units,kind,factor",
    [("m", "height", 1), ("meters", "height", 1), ("km", "height", 1000), ("Kilometers", "height", 1000),
     ("Pa", "pressure", 0.01), ("hPa", "pressure", 1), ("mb", "pressure", 1), (None, "height", 1)],
)
def test_vertical_units(units, kind, factor):
    assert physics.vertical_scale(units, kind) == factor


@pytest.mark.parametrize("units,kind", [("gpm", "height"), ("furlong", "height"), ("atm", "pressure"), ("m", "depth")])
def test_vertical_units_refused(units, kind):
    with pytest.raises(ValueError):
        physics.vertical_scale(units, kind)


def test_vertical_scale_priority():
    assert physics.vertical_scale("gpm", scale=0.1) == 0.1
    assert physics.vertical_scale("gpm", override="km") == 1000.0


def test_scalars(spark):
    row = spark.range(1).select(
        physics.olr_to_tb(F.lit(250.0)).alias("tb"),
        physics.linear_to_dbz(physics.dbz_to_linear(F.lit(37.0))).alias("dbz"),
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"),
        physics.peakedness_limit(F.lit(-1.0), 10, 40).alias("p0"),
        physics.peakedness_limit(F.lit(20.0), 10, 40).alias("p1"),
        physics.peakedness_limit(F.lit(41.0), 10, 40).alias("p2"),
        timeparse.compact_epoch(F.lit("20250101.1200")).alias("e"),
        timeparse.name_time(F.lit("/a/b/cloudid_20140807_1215.nc"), "cloudid_", "yyyyoodd_hhmm").cast("string").alias("t"),
    ).first()
    assert 240 < row.tb < 290
    assert row.dbz == pytest.approx(37.0)
    assert row.km == pytest.approx(6371 * math.pi / 180)
    assert (row.p0, row.p2) == (10, 0) and row.p1 == pytest.approx(10 * math.cos(math.pi / 4))
    assert row.e == 1735732800
    assert row.t == "2014-08-07 12:15:00"


@pytest.mark.parametrize("x,y,heading", [(0, 1, 0), (1, 0, 90), (0, -1, 180), (-1, 0, 270), (0, 0, None)])
def test_heading(spark, x, y, heading):
    v = geo.movement_vector(F.lit(x), F.lit(y), F.lit(10.0))
    assert spark.range(1).select(v["heading"].alias("h")).first().h == heading


def test_cell_area_sums_to_the_band(spark):
    rows = [(y, x, float(y - 5), float(x)) for y in range(11) for x in range(20)]
    grid = spark.createDataFrame(rows, "y int, x int, lat double, lon double")
    total = geo.with_cell_area(grid).agg(F.sum("area_km2")).first()[0]
    exact = 6371**2 * math.radians(20) * 2 * math.sin(math.radians(5.5))
    assert total == pytest.approx(exact, rel=1e-3)


def test_nested_cells_are_equal_area_and_nested(spark):
    rng = np.random.default_rng(0)
    n = 120_000
    pdf = pd.DataFrame({"lat": np.degrees(np.arcsin(rng.uniform(-1, 1, n))), "lon": rng.uniform(-180, 180, n)})
    df = spark.createDataFrame(pdf)
    cells = df.select(*[regrid.nested_cell(F.col("lat"), F.col("lon"), z).alias(f"c{z}") for z in (1, 2, 5)]).toPandas()
    counts = cells.c2.value_counts()
    assert set(counts.index) == set(range(192))
    assert abs(counts - n / 192).max() < 6 * math.sqrt(n / 192)
    assert (cells.c2 // 4 == cells.c1).all() and (cells.c5 // 4**4 == cells.c1).all()
    for lat, lon, face in [(0.0, 0.0, 4), (90.0, 45.0, 0), (-90.0, 45.0, 8), (0.0, 270.0, 7)]:
        assert spark.range(1).select(regrid.nested_cell(F.lit(lat), F.lit(lon), 0)).first()[0] == face


def test_refine_needs_an_odd_ratio(spark):
    with pytest.raises(ValueError):
        regrid.refine(spark.createDataFrame([(1, 0, 0)], "frame_id long, y int, x int"), 2)


def test_coarsen_then_refine(spark):
    rows = [(1, y, x, float(y // 3)) for y in range(9) for x in range(6)]
    df = spark.createDataFrame(rows, "frame_id long, y int, x int, v double")
    fine = regrid.refine(regrid.coarsen(df, ["frame_id"], "v", 3), 3)
    assert fine.select(*df.columns).exceptAll(df).isEmpty()
