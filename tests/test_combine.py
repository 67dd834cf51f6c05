"""Combined runs equal their parts, with ids that do not collide."""

from __future__ import annotations

import pytest

from driftfield.operators.combine import combine_runs, id_blocks

SCHEMA = "track_id long, time_idx int, merge_track long, split_track long, area double"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ids_and_pointers_move_together(spark):
    a = spark.createDataFrame([(1, 0, None, None, 1.0), (2, 0, 1, None, 2.0)], SCHEMA)
    b = spark.createDataFrame([(1, 0, None, 2, 3.0), (2, 0, None, None, 3.0)], SCHEMA)
    got = combine_runs({"a": a, "b": b})
    assert rows(got, "run", "track_id") == [("a", 1), ("a", 2), ("b", 3), ("b", 4)]
    assert [(r.merge_track, r.split_track) for r in got.orderBy("track_id").collect()] == [
        (None, None), (1, None), (None, 4), (None, None)
    ]
    for name, part in (("a", a), ("b", b)):
        own = got.where(f"run = '{name}'")
        assert rows(own, "time_idx", "area") == rows(part, "time_idx", "area")


def test_pointer_to_a_track_that_is_gone_stays_in_its_block(spark):
    a = spark.createDataFrame([(1, 0, 9, None, 1.0)], SCHEMA)
    b = spark.createDataFrame([(1, 0, None, None, 1.0)], SCHEMA)
    assert id_blocks({"a": a, "b": b}) == {"a": 0, "b": 9}


def test_tables_of_the_same_runs_stay_in_step(spark):
    a = spark.createDataFrame([(5, 0, None, None, 1.0)], SCHEMA)
    b = spark.createDataFrame([(1, 0, None, None, 1.0)], SCHEMA)
    shifts = id_blocks({"a": a, "b": b})
    ends = {"a": a.select("track_id").where("track_id < 0"), "b": b.select("track_id")}
    assert rows(combine_runs(ends, shifts), "run", "track_id") == [("b", 6)]


def test_columns_of_some_runs_and_empty_runs(spark):
    a = spark.createDataFrame([(1, 7)], "track_id int, extra int")
    b = spark.createDataFrame([], "track_id long")
    c = spark.createDataFrame([(1,), (1,)], "track_id long")
    got = combine_runs({"a": a, "b": b, "c": c})
    assert sorted((r.run, r.track_id, r.extra or 0) for r in got.collect()) == [("a", 1, 7), ("c", 2, 0), ("c", 2, 0)]


def test_a_clashing_name_and_no_runs_are_errors(spark):
    with pytest.raises(ValueError, match="already has a column"):
        combine_runs({"a": spark.createDataFrame([(1, "x")], "track_id long, run string")})
    with pytest.raises(ValueError, match="no run"):
        combine_runs({})
