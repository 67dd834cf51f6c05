"""Connected components of an edge table.

Small groups are solved directly; large ones by alternating star contraction:
every round replaces each vertex's neighbourhood by a star around its smallest
member (first for larger neighbours, then for smaller ones).  Minima are
partially aggregated before the shuffle and hub vertices only meet their single
minimum in the join, so a giant component is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.workspace import Workspace

DIRECT_LIMIT = 1 << 20


def connected_components(
    edges: DataFrame,
    ws: Workspace,
    keys: Sequence[str] = (),
    src: str = "src",
    dst: str = "dst",
    direct_limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """(keys, node, component) for every vertex with an edge; component = smallest vertex.

    Keys with at most ``direct_limit`` edges are solved in one grouped pass.  The
    others, and everything when there are no keys, go through star contraction.
    """
    keys = list(keys)
    current = ws.write(
        edges.where(F.col(src) != F.col(dst))
        .select(
            *keys,
            F.greatest(src, dst).cast("long").alias("u"),
            F.least(src, dst).cast("long").alias("v"),
        )
        .distinct(),
        "edges",
    )
    if not keys:
        return _contract(current, ws, keys)
    sizes = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    small = current.join(sizes.where(F.col("_n") <= direct_limit), keys).drop("_n")
    solved = _direct(small, keys)
    large = sizes.where(F.col("_n") > direct_limit)
    if large.isEmpty():
        return solved
    rest = ws.write(current.join(large, keys).drop("_n"), "large_groups")
    return solved.unionByName(_contract(rest, ws, keys))


def _direct(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Components of one key's edges by hooking larger roots to smaller ones."""
    fields = {f.name: f for f in edges.schema.fields}
    schema = T.StructType(
        [*[fields[k] for k in keys], T.StructField("node", T.LongType()), T.StructField("component", T.LongType())]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = pdf[["u", "v"]].to_numpy()
        nodes, index = np.unique(ends, return_inverse=True)
        a, b = index.reshape(ends.shape).T
        out = pd.DataFrame({"node": nodes, "component": nodes[hook(len(nodes), a, b)]})
        for k in keys:
            out[k] = pdf[k].iat[0]
        return out[[*keys, "node", "component"]]

    return edges.groupBy(*keys).applyInPandas(solve, schema)


def hook(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of each vertex's component for edges (a, b) over 0..n-1."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _contract(current: DataFrame, ws: Workspace, keys: list[str]) -> DataFrame:
    while not _is_forest_of_stars(current, keys):
        current = ws.write(_small_star(_large_star(current, keys), keys), "stars")
    stars = current.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    hubs = current.select(*keys, F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(hubs).distinct()


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    both = edges.select(*keys, "u", "v").unionByName(
        edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
    )
    low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.where("v > u")
        .join(low, [*keys, "u"])
        .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v")
        .distinct()
    )


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    low = edges.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    moved = edges.join(low, [*keys, "u"]).select(
        *keys, F.col("v").alias("u"), F.col("m").alias("v")
    )
    own = low.select(*keys, "u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u != v").distinct()


def _is_forest_of_stars(edges: DataFrame, keys: list[str]) -> bool:
    """Every larger vertex has one edge, and no centre is itself a larger vertex."""
    ends = edges.select(*keys, F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(
        edges.select(*keys, F.col("v").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("top")).distinct()
    )
    odd = ends.groupBy(*keys, "n").agg((F.sum("low") + F.max("top")).alias("role")).where("role > 1")
    return odd.isEmpty()
