"""Per-feature, per-(track, time) and per-track statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.functions.physics import CORE, COLD
from driftfield.operators.asof import nearest_in_time
from driftfield.operators.ranking import bucketed_row_number
from driftfield.operators.tiles import Wrap

ID_BLOCK = 65536
MATCH_S = 1.0


def circular_mean(value: Column, low: float, high: float) -> Column:
    """Mean on a circle whose period is ``high - low``."""
    angle = (value - low) * (2.0 * 3.141592653589793 / (high - low))
    mean = F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))
    turn = F.when(mean < 0, mean + 2.0 * 3.141592653589793).otherwise(mean)
    return turn / (2.0 * 3.141592653589793) * (high - low) + low


def feature_stats(
    pixels: DataFrame,
    extra: dict[str, Column] | None = None,
    lon_range: tuple[float, float] | None = None,
    lat_range: tuple[float, float] | None = None,
) -> DataFrame:
    """One row per (frame, feature) from pixels carrying lat, lon and area_km2.

    Ranges switch the mean position to a circular mean (periodic domains).
    """
    meanlat = circular_mean(F.col("lat"), *lat_range) if lat_range else F.avg("lat")
    meanlon = circular_mean(F.col("lon"), *lon_range) if lon_range else F.avg("lon")
    columns = {
        "npix": F.count(F.lit(1)),
        "area": F.sum("area_km2"),
        "meanlat": meanlat,
        "meanlon": meanlon,
        **(extra or {}),
    }
    return pixels.groupBy("frame_id", "feature_id").agg(*[c.alias(n) for n, c in columns.items()])


def tb_extras(tb: str = "tb", kind: str = "cloudtype") -> dict[str, Column]:
    """Cold-cloud columns; the coldest pixel is the first in raster order on ties."""
    core, cold = F.col(kind) == CORE, F.col(kind) == COLD
    coldest = F.min(F.when(F.col(tb).isNotNull(), F.struct(F.col(tb), F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))))
    return {
        "core_area": F.coalesce(F.sum(F.when(core, F.col("area_km2"))), F.lit(0.0)),
        "cold_area": F.coalesce(F.sum(F.when(cold, F.col("area_km2"))), F.lit(0.0)),
        "corecold_mintb": F.min(tb),
        "corecold_meantb": F.avg(tb),
        "core_meantb": F.avg(F.when(core, F.col(tb))),
        "mintb_lat": coldest["lat"],
        "mintb_lon": coldest["lon"],
    }


def radar_extras(echo_tops: tuple[int, ...] = (10, 20, 30, 40, 50)) -> dict[str, Column]:
    """Radar-cell columns from pixels with x_km, y_km, dbz_comp, is_core, range_ok, echotopNN."""
    core = F.col("is_core") == 1
    out = {}
    for name, col in (("meanlat", "lat"), ("meanlon", "lon"), ("mean_y", "y_km"), ("mean_x", "x_km")):
        out[f"core_{name}"] = F.avg(F.when(core, F.col(col)))
        out[f"cell_{name}"] = F.avg(col)
    out["core_area"] = F.coalesce(F.sum(F.when(core, F.col("area_km2"))), F.lit(0.0))
    out["cell_area"] = F.sum("area_km2")
    out["max_dbz"] = F.max("dbz_comp")
    out["maxrange_flag"] = F.min("range_ok")
    for top in echo_tops:
        out[f"maxeth_{top}dbz"] = F.max(f"echotop{top}")
    return out


def track_series(points: DataFrame, stats: DataFrame, frames: DataFrame) -> DataFrame:
    """Statistics along each track with ``time_idx`` counted from initiation.

    A track that owns several features in one frame keeps the first of them.
    Features are aggregated before this join, so only feature rows move.
    """
    first = Window.partitionBy("track_id", "frame_id").orderBy("feature_id")
    along = Window.partitionBy("track_id").orderBy("frame_id")
    return (
        points.withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .drop("_n")
        .join(stats, ["frame_id", "feature_id"])
        .join(frames.select("frame_id", "epoch_s"), "frame_id")
        .withColumn("time_idx", (F.row_number().over(along) - 1).cast("int"))
        .withColumnsRenamed({"feature_id": "cloudnumber", "epoch_s": "base_time"})
    )


def track_ends(series: DataFrame, tolerance_s: float = MATCH_S) -> DataFrame:
    """Duration, start and end of every track, with the partner at a split or merge.

    A track that ends by merging is connected to its partner one step after the
    common time, one that starts by splitting one step before it.  The partner's time
    is the nearest one less than ``tolerance_s`` away (the earlier of two as near).
    """
    row = F.struct(
        "time_idx", "base_time", "track_status", "merge_track", "split_track"
    )
    ends = series.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("track_duration"),
        F.min(row).alias("_s"),
        F.max(row).alias("_e"),
    ).select(
        "track_id",
        "track_duration",
        F.col("_s.track_status").alias("start_status"),
        F.col("_e.track_status").alias("end_status"),
        F.col("_s.base_time").alias("start_basetime"),
        F.col("_e.base_time").alias("end_basetime"),
        F.col("_s.split_track").alias("start_split_tracknumber"),
        F.col("_e.merge_track").alias("end_merge_tracknumber"),
    )
    along = Window.partitionBy("track_id").orderBy("time_idx")
    partner = series.select(
        F.col("track_id").alias("_pid"),
        F.col("base_time").alias("_at"),
        F.col("time_idx").alias("_pi"),
        F.lag("cloudnumber").over(along).alias("_before"),
        F.lead("cloudnumber").over(along).alias("_after"),
    )

    def met(number: str, time: str, cloud: str) -> DataFrame:
        linked = ends.where(F.col(number).isNotNull()).select(
            "track_id", F.col(number).alias("_pid"), F.col(time).alias("_at")
        )
        return nearest_in_time(linked, partner, ["track_id"], ["_pid"], "_at", ["_pi", cloud], tolerance_s)

    merged = met("end_merge_tracknumber", "end_basetime", "_after").select(
        "track_id",
        (F.col("_pi") + 1).alias("end_merge_timeindex"),
        F.col("_after").alias("end_merge_cloudnumber"),
    )
    split = met("start_split_tracknumber", "start_basetime", "_before").where("_pi > 0").select(
        "track_id",
        (F.col("_pi") - 1).alias("start_split_timeindex"),
        F.col("_before").alias("start_split_cloudnumber"),
    )
    return ends.join(split, "track_id", "left").join(merged, "track_id", "left")


def drop_short_tracks(series: DataFrame, ends: DataFrame, min_duration: int) -> DataFrame:
    """Series without short unlinked tracks; ids become dense and pointers follow.

    Pointers to a removed track become NULL.
    """
    keep = ends.where(
        ~(
            (F.col("track_duration") < min_duration)
            & F.col("start_split_timeindex").isNull()
            & F.col("end_merge_timeindex").isNull()
        )
    ).select("track_id")
    ids = bucketed_row_number(
        keep, [], {"_block": F.floor(F.col("track_id") / ID_BLOCK)}, [F.col("track_id")], "_new"
    )

    def pointer(col: str) -> DataFrame:
        return ids.select(F.col("track_id").alias(col), F.col("_new").alias(f"_{col}"))

    unlinked = -F.col("track_id")
    return (
        series.join(ids, "track_id")
        .withColumns(
            {c: F.coalesce(c, unlinked) for c in ("merge_track", "split_track")}
        )
        .join(pointer("merge_track"), "merge_track", "left")
        .join(pointer("split_track"), "split_track", "left")
        .drop("track_id", "merge_track", "split_track")
        .withColumnsRenamed(
            {"_new": "track_id", "_merge_track": "merge_track", "_split_track": "split_track"}
        )
    )


def unwrap_positions(series: DataFrame, columns: dict[str, float], max_fraction: float) -> DataFrame:
    """Make positions continuous across a periodic edge.

    ``columns`` maps a position column to its jump threshold; every step beyond
    it shifts the rest of the track by threshold / max_fraction.  ``pbc_flag``
    is 1 for tracks with a shift in any column.
    """
    along = Window.partitionBy("track_id").orderBy("time_idx")
    out = series
    flag = F.lit(0)
    for col, thresh in columns.items():
        step = F.col(col) - F.lag(col).over(along)
        turn = F.when(step > thresh, -1).when(step < -thresh, 1).otherwise(0)
        out = out.withColumn(f"_turn_{col}", turn)
        flag = F.greatest(flag, F.abs(F.col(f"_turn_{col}")))
    out = out.withColumn("pbc_flag", F.max(flag).over(Window.partitionBy("track_id")))
    for col, thresh in columns.items():
        turns = F.sum(f"_turn_{col}").over(along)
        out = out.withColumn(col, F.col(col) + turns * (thresh / max_fraction))
    return out.drop(*[f"_turn_{c}" for c in columns])


def coordinate_ranges(grid: DataFrame, periodic_y: bool, periodic_x: bool) -> dict[str, tuple[float, float] | None]:
    """lat_range and lon_range of the pixel centres along periodic axes, as one row of extremes."""
    if not (periodic_y or periodic_x):
        return {"lat_range": None, "lon_range": None}
    r = grid.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))]).first()
    return {
        "lat_range": (r.low_lat, r.high_lat) if periodic_y else None,
        "lon_range": (r.low_lon, r.high_lon) if periodic_x else None,
    }


def periodic_shift(pixels: DataFrame, keys: list[str], axis: str, size: int, fraction: float = 0.5) -> DataFrame:
    """Shift that rolls each feature away from the periodic edge (0 = leave it).

    The largest gap between occupied indices must exceed ``fraction`` of the domain (and
    hold an index); the part behind the gap then moves to the front.
    """
    used = pixels.select(*keys, axis).distinct()
    along = Window.partitionBy(*keys).orderBy(axis)
    gaps = used.withColumn("_next", F.lead(axis).over(along)).withColumn("_gap", F.col("_next") - F.col(axis))
    widest = gaps.groupBy(*keys).agg(F.max(F.struct("_gap", (-F.col(axis)).alias("_at"), "_next")).alias("_g"))
    shift = F.when(F.col("_g._gap") > max(1.0, size * fraction), F.lit(size) - F.col("_g._next")).otherwise(0)
    return widest.select(*keys, shift.cast("int").alias("shift"))


def unrolled(pixels: DataFrame, keys: list[str], wrap: Wrap) -> DataFrame:
    """``pixels`` with the positions of features that lie on both sides of a periodic edge rolled into one piece.

    ``_shift_y`` and ``_shift_x`` tell by how much (0 for all others).
    """
    out, rolled = pixels, dict(wrap.axes())
    for axis in ("y", "x"):
        if axis not in rolled:
            out = out.withColumn(f"_shift_{axis}", F.lit(0))
            continue
        n = rolled[axis]
        ends = pixels.where(F.col(axis).isin(0, n - 1)).groupBy(*keys)
        both = ends.agg(F.min(axis).alias("_low"), F.max(axis).alias("_high")).where("_low < _high")
        shift = periodic_shift(pixels.join(both.select(*keys), keys, "left_semi"), keys, axis, n, 0.0)
        out = out.join(shift.withColumnRenamed("shift", f"_shift_{axis}"), keys, "left")
        out = out.withColumn(f"_shift_{axis}", F.coalesce(f"_shift_{axis}", F.lit(0)))
        out = out.withColumn(axis, F.pmod(F.col(axis) + F.col(f"_shift_{axis}"), F.lit(n)).cast("int"))
    return out


def feature_bounds(pixels: DataFrame, keys: list[str], shape: tuple[int, int], margin: int = 10) -> DataFrame:
    """Index box of each feature with a margin, clipped to the grid (upper ends exclusive)."""
    out = pixels.groupBy(*keys)
    aggs = []
    for axis, size in zip(("y", "x"), shape):
        low, high = F.min(axis), F.max(axis)
        aggs.append(F.when(low <= margin, 0).otherwise(low - margin).alias(f"min{axis}"))
        aggs.append(F.when(high >= size - margin, size).otherwise(high + margin + 1).alias(f"max{axis}"))
    return out.agg(*aggs)


def to_dense(series: DataFrame, columns: list[str]) -> DataFrame:
    """One array per statistic and track, padded with NULL to the longest track."""
    longest = series.agg(F.max("time_idx")).scalar()
    slots = series.select("track_id").distinct().select(
        "track_id", F.explode(F.sequence(F.lit(0), longest)).alias("time_idx")
    )
    rows = slots.join(series.select("track_id", "time_idx", *columns), ["track_id", "time_idx"], "left")
    packed = rows.groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct("time_idx", *columns))).alias("_s")
    )
    return packed.select("track_id", *[F.col(f"_s.{c}").alias(c) for c in columns])


def to_sparse(dense: DataFrame, columns: list[str]) -> DataFrame:
    """Back from arrays to one row per (track, time) that has a value."""
    zipped = dense.select("track_id", F.posexplode(F.arrays_zip(*columns)).alias("time_idx", "_v"))
    rows = zipped.select("track_id", "time_idx", *[F.col(f"_v.{c}").alias(c) for c in columns])
    return rows.where(F.coalesce(*columns).isNotNull())
