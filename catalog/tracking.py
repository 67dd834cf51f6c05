"""Identification, linking and track numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as sql
from catalog.registry import query
from catalog.stages import NX, NY, STEP_S, Stages
from driftfield.operators import label, link, tracks


@query("gridded_field", sql.query("field", "SELECT frame_id, y, x, v, z, tb, rain FROM field"))
def gridded_field(spark, sf):
    return Stages(spark, sf).field().select("frame_id", "y", "x", "v", "z", "tb", "rain")


@query("label_components", sql.query("regions", "SELECT frame_id, y, x, region FROM regions"))
def label_components(spark, sf):
    return Stages(spark, sf).regions().select("frame_id", "y", "x", "region")


@query("sort_renumber", sql.query("labels", "SELECT frame_id, y, x, feature_id FROM labels"))
def sort_renumber(spark, sf):
    return Stages(spark, sf).labels().select("frame_id", "y", "x", "feature_id")


@query("link_overlap", sql.query("links", "SELECT * FROM links"))
def link_overlap(spark, sf):
    return Stages(spark, sf).links()


@query("track_points", sql.query("points", "SELECT * FROM points"))
def track_points(spark, sf):
    return Stages(spark, sf).points()
