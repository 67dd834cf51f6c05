"""Cells of the whole sphere to positions and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftfield.operators import regrid


@pytest.mark.parametrize("zoom", [0, 1, 3, 9])
def test_centres_lie_in_their_cells(spark, zoom):
    cells = spark.range(12 << (2 * zoom)).select(F.col("id").alias("cell")) if zoom < 5 else spark.createDataFrame(
        pd.DataFrame({"cell": np.random.default_rng(1).integers(0, 12 << (2 * zoom), 20_000)})
    )
    placed = regrid.cell_centres(cells, zoom)
    again = placed.withColumn("again", regrid.nested_cell(F.col("lat_hp"), F.col("lon_hp"), zoom))
    assert again.where("again <> cell").isEmpty() and again.count() > 0
    assert placed.where("lon_hp < 0 or lon_hp >= 360 or abs(lat_hp) >= 90").isEmpty()


@pytest.mark.parametrize("zoom", [0, 2, 4])
def test_ring_numbers_count_the_cells_from_the_north(spark, zoom):
    cells = spark.range(12 << (2 * zoom)).select(F.col("id").alias("cell"))
    rows = regrid.cell_centres(cells, zoom).withColumnRenamed("ring_cell", "ring").toPandas()
    rows = rows.sort_values("ring").reset_index(drop=True)
    assert (rows.ring == np.arange(len(rows))).all()
    lat = rows.lat_hp.round(9).to_numpy()
    assert (np.diff(lat) <= 0).all()
    assert all((np.diff(part.lon_hp) > 0).all() for _, part in rows.groupby(lat))
    z = np.sin(np.radians(lat))
    assert abs(z.mean()) < 1e-12  # as many on both sides


def test_positions_near_the_poles_and_the_seam(spark):
    at = [(90.0, 10.0), (-90.0, 359.9), (89.999, 0.0), (-89.999, 90.0), (41.9, 360.0), (-41.8, -0.1), (0.0, 0.0), (0.0, 359.999)]
    rows = spark.createDataFrame(at, "lat double, lon double").withColumn("cell", regrid.nested_cell(F.col("lat"), F.col("lon"), 7))
    for r in regrid.cell_centres(rows, 7).collect():
        z = np.sin(np.radians([r.lat, r.lat_hp]))
        gap = np.radians((r.lon - r.lon_hp + 180) % 360 - 180)
        flat = np.cos(np.radians(r.lat)) * np.cos(np.radians(r.lat_hp)) * np.cos(gap) + z[0] * z[1]
        assert np.degrees(np.arccos(min(1.0, flat))) < 58.6 / 2**7 * 1.2
