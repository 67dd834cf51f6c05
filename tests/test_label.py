from __future__ import annotations

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.operators import components, label, ranking
from tests.conftest import drawn


def flood(mask, wrap=False):
    h, w = mask.shape
    out = -np.ones(mask.shape, dtype=np.int64)
    for y in range(h):
        for x in range(w):
            if mask[y, x] and out[y, x] < 0:
                out[y, x] = (y << 32) + x
                todo = deque([(y, x)])
                while todo:
                    a, b = todo.popleft()
                    for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                        if wrap:
                            c, d = c % h, d % w
                        if 0 <= c < h and 0 <= d < w and mask[c, d] and out[c, d] < 0:
                            out[c, d] = (y << 32) + x
                            todo.append((c, d))
    return out


@pytest.mark.parametrize("tile,wrap,share", [(4, False, 0.62), (64, False, 0.6), (5, True, 0.58), (64, True, 0.5)])
def test_regions_match_flooding(spark, ws, tile, wrap, share):
    rng = np.random.default_rng(3)
    mask = rng.random((23, 19)) < share
    ys, xs = np.nonzero(mask)
    px = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(ys, xs)], "frame_id long, y int, x int")
    got = label.label_regions(px, ws, tile=tile, shape=mask.shape, periodic_x=wrap, periodic_y=wrap).toPandas()
    want = flood(mask, wrap)
    assert (got.region.to_numpy() == want[got.y, got.x]).all()


def test_regions_do_not_cross_values(spark, ws):
    px = drawn(spark, [["1122", "1122"]], digits=True)
    got = label.label_regions(px, ws, within="feature_id", tile=3).select("feature_id", "region").distinct()
    assert got.count() == 2


def test_size_filter_and_rank(spark, ws):
    labels = drawn(spark, [["11112", "33122", "3.122"]], digits=True).withColumn("region", F.col("feature_id").cast("long"))
    sized = label.rank_regions(labels, 3).toPandas().set_index("region")
    assert dict(sized.feature_id) == {1: 1, 2: 2}
    by_area = label.rank_regions(labels.withColumn("area_km2", F.lit(20.0)), min_area=90.0, area_col="area_km2").toPandas()
    assert sorted(by_area.region) == [1, 2]
    assert label.rank_regions(labels, min_area=500.0).isEmpty()


def test_equal_sizes_rank_the_later_region_first(spark):
    labels = drawn(spark, [["11.22.33"]], digits=True).withColumn("region", F.col("feature_id").cast("long"))
    got = label.rank_regions(labels).toPandas().set_index("region").feature_id
    assert dict(got) == {3: 1, 2: 2, 1: 3}


def test_renumber_pair(spark):
    px = drawn(spark, [["11122233"]], digits=True).withColumn("second", F.lit(3))
    out, feats = label.renumber_pair(px, "feature_id", "second", min_npix=2)
    rows = out.toPandas()
    assert set(rows.second) == {0}
    assert set(rows.feature_id) == {0, 1, 2}
    assert feats.count() == 2


@pytest.mark.parametrize("limit", [0, 250, 10_000])
def test_components_of_a_long_path_and_a_hub(spark, ws, limit):
    path = [(1, i, i + 1) for i in range(0, 200)]
    hub = [(1, 1000, 1000 + i) for i in range(1, 300)]
    other = [(2, 5, 7), (2, 9, 7)]
    edges = spark.createDataFrame(path + hub + other, "k long, src long, dst long")
    got = components.connected_components(edges, ws, ["k"], direct_limit=limit).toPandas()
    assert (got[(got.k == 1) & (got.node <= 200)].component == 0).all()
    assert (got[(got.k == 1) & (got.node >= 1000)].component == 1000).all()
    assert (got[got.k == 2].component == 5).all()
    assert len(got) == 201 + 300 + 3


def test_bucketed_row_number_equals_a_plain_window(spark):
    from pyspark.sql import Window

    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("v"), "id")
    got = ranking.bucketed_row_number(df, ["g"], {"_b": F.floor(F.col("v") / 7)}, [F.col("v"), F.col("id")], "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("long"))
    assert got.select("g", "v", "id", "n").exceptAll(want.select("g", "v", "id", "n")).isEmpty()


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 0.995, 1.0])
def test_exact_quantile_equals_numpy(spark, q):
    rng = np.random.default_rng(5)
    values = {g: np.round(rng.exponential(3, n), 2) for g, n in ((1, 1), (2, 2), (3, 777), (4, 5000))}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.q for r in ranking.exact_quantile(df, ["g"], "v", q, "q", bins=16).collect()}
    for g, vs in values.items():
        assert got[g] == pytest.approx(np.quantile(vs, q), abs=1e-12)
