"""Catalogue queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "events")
QUICK = (
    "gridded_field", "label_components", "link_overlap", "track_points", "track_points_gaps", "remove_short_tracks",
    "attach_merge_split", "rain_features", "map_pixels", "classify_echo", "expand_cores", "echo_top_heights",
    "feature_motion", "rain_rate_histograms", "label_components_tiled",
)
NAMES = [n for n in entry.oracle_sql() if n in QUICK or os.environ.get("CATALOG_FULL")]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dropna().map(type).unique()
        if len(kind) and all(issubclass(k, (bool, np.bool_)) for k in kind):
            df[c] = df[c].astype(str)
        elif len(kind) and all(issubclass(k, (int, float, np.number)) for k in kind):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = normal(entry.queries()[name](spark, SF).toPandas())
    want = normal(duck.execute(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-9, atol=1e-9)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_each_feature_is_in_one_track(spark):
    points = entry.queries()["track_points"](spark, SF).toPandas()
    assert not points.duplicated(["frame_id", "feature_id"]).any()
    spans = points.groupby("track_id").frame_id.agg(["min", "max", "nunique"])
    assert (spans["max"] - spans["min"] + 1 == spans["nunique"]).all()
