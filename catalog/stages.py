"""Shared stages of the catalogue queries on the driver's tables.

``lineitem`` is read as a moving field: a frame per ship month, a 20 x 20 grid
of part numbers.  The standardised quantity drives a brightness temperature, the
standardised discount a rain rate, and (frame, pixel, line number) a reflectivity
column.  Each stage is written once per Spark application and table folder and
then shared by the queries that start from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.functions import geo, physics
from driftfield.operators import label, link, mapback, precip, stats, systems, tracks
from driftfield.sources import tables
from driftfield.workspace import Workspace, workspace_for

NY = NX = 20
STEP_S = 3600
COLD_K = 241.0
OTHRESH = 0.3
TIMEGAP_H = 3.1
MIN_NPIX = 1
PIXEL_KM = 11.0
LINGER = 4
DT_H = 1.0
TB_CORE, TB_COLD, TB_WARM, TB_CLOUD = 225.0, 241.0, 261.0, 261.0
SYSTEM_AREA, SYSTEM_HOURS, SYSTEM_GAP = 400.0, 3.0, 1
RAIN_MIN, RAIN_HEAVY = 3.0, 6.0


def rounded(df: DataFrame, digits: int = 9, **special: int) -> DataFrame:
    """Doubles rounded for comparison; adding zero folds the two zeros into one."""

    def places(name: str) -> int:
        return special.get(name, min(digits, 6) if "area" in name or "vol" in name else digits)

    return df.select(
        *[
            (F.round(f.name, places(f.name)) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )

_memo: dict[tuple, DataFrame] = {}


def forget_stages() -> None:
    """Drop all remembered stages (the benchmark times every stage afresh)."""
    _memo.clear()


@dataclass(frozen=True)
class FieldSpec:
    """How ``lineitem`` becomes frames: time step, grid size, steps a pixel lingers."""

    unit: str = "month"
    ny: int = NY
    nx: int = NX
    linger: int = LINGER


class Stages:
    def __init__(self, spark: SparkSession, sf_dir: str, spec: FieldSpec = FieldSpec()):
        self.spark = spark
        self.sf_dir = sf_dir
        self.spec = spec
        self.ws: Workspace = workspace_for(spark)

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.spec, name)
        if key not in _memo:
            _memo[key] = self.ws.write(build(), name.replace("/", "_"))
        return _memo[key]

    def table(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, self.sf_dir, name)

    # -- field -----------------------------------------------------------
    def ship_time(self):
        return F.date_trunc(self.spec.unit, "l_shipdate").cast("timestamp")

    def raw_field(self) -> DataFrame:
        """Pixel sums per time step, each still felt in the following steps."""
        spec = self.spec
        part = F.col("l_partkey")
        rows = self.table("lineitem").select("l_shipdate", "l_partkey", "l_quantity", "l_discount")
        step = tables.grid_frames(
            rows,
            self.ship_time(),
            F.floor(part / spec.nx) % spec.ny,
            part % spec.nx,
            {"v": F.sum("l_quantity"), "d": F.sum(F.round(F.col("l_discount") * 100))},
        )
        return tables.lingering(step, spec.linger, spec.unit)

    def frames(self) -> DataFrame:
        def build() -> DataFrame:
            times = self.table("lineitem").select(self.ship_time().alias("ts")).distinct()
            return tables.frame_table(tables.lingering_times(times, self.spec.linger, self.spec.unit), STEP_S)

        return self.keep("frames", build)

    def field(self) -> DataFrame:
        """frame_id, y, x, v, z, tb, rain."""

        def build() -> DataFrame:
            px = self.raw_field().join(self.frames().select("frame_id", "ts"), "ts").drop("ts")
            px = tables.standardised(px, {"v": "z", "d": "zd"})
            return px.select(
                "frame_id", "y", "x", "v",
                F.round("z", 6).alias("z"),
                F.round(F.lit(250.0) - F.col("z") * 15.0, 4).alias("tb"),
                F.round(F.greatest(F.col("zd") * 4.0 + 3.0, F.lit(0.0)), 4).alias("rain"),
            )

        return self.keep("field", build)

    def grid(self) -> DataFrame:
        """y, x, lat, lon, area_km2, landfrac of the synthetic 0.1-degree grid."""
        cells = (
            self.spark.range(self.spec.ny)
            .select(F.col("id").cast("int").alias("y"))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(self.spec.nx - 1))))
            .withColumns(
                {
                    "lat": (F.col("y") - 10) / 10,
                    "lon": (F.col("x") + 200) / 10,
                    "landfrac": F.when(F.col("x") < 10, 100.0).otherwise(0.0),
                }
            )
        )
        return geo.with_cell_area(cells).select("y", "x", "lat", "lon", "area_km2", "landfrac")

    # -- generic tracking ---------------------------------------------------
    def regions(self) -> DataFrame:
        def build() -> DataFrame:
            # the fields ride along, so statistics never join back to the full field
            cold = self.field().where(F.col("tb") < COLD_K).select("frame_id", "y", "x", "tb", "rain")
            return label.label_regions(cold, self.ws, shape=(self.spec.ny, self.spec.nx))

        return self.keep("regions", build)

    def features(self) -> DataFrame:
        return self.keep("features", lambda: label.rank_regions(self.regions(), MIN_NPIX))

    def labels(self) -> DataFrame:
        return self.keep("labels", lambda: label.renumber(self.regions(), self.features()))

    def pairs(self, timegap_h: float = TIMEGAP_H) -> DataFrame:
        return link.frame_pairs(self.frames(), timegap_h)

    def links(self) -> DataFrame:
        return self.keep(
            "links", lambda: link.overlap_links(self.labels(), self.pairs(), OTHRESH, features=self.features())
        )

    def points(self) -> DataFrame:
        return self.keep(
            "points",
            lambda: tracks.number_tracks(self.features(), self.links(), self.pairs(), self.ws, OTHRESH),
        )

    # -- statistics ---------------------------------------------------------
    def cloud_pixels(self) -> DataFrame:
        """Labelled pixels with temperature class, rain, position and area."""

        def build() -> DataFrame:
            return self.labels().join(self.grid(), ["y", "x"]).withColumn(
                "cloudtype", physics.cloud_type("tb", TB_CORE, TB_COLD, TB_WARM, TB_CLOUD)
            )

        return self.keep("cloud_pixels", build)

    def feature_stats(self) -> DataFrame:
        return self.keep(
            "feature_stats", lambda: stats.feature_stats(self.cloud_pixels(), stats.tb_extras())
        )

    def all_series(self) -> DataFrame:
        return self.keep(
            "all_series", lambda: stats.track_series(self.points(), self.feature_stats(), self.frames())
        )

    def series(self) -> DataFrame:
        """Track series without short unlinked tracks."""
        return self.keep(
            "series",
            lambda: stats.drop_short_tracks(self.all_series(), stats.track_ends(self.all_series()), 2),
        )

    def ends(self) -> DataFrame:
        return self.keep("ends", lambda: stats.track_ends(self.series()))

    # -- systems --------------------------------------------------------------
    def systems(self) -> DataFrame:
        return self.keep(
            "systems",
            lambda: systems.cold_systems(self.series(), SYSTEM_AREA, SYSTEM_HOURS, SYSTEM_GAP, DT_H),
        )

    def attached(self) -> DataFrame:
        return self.keep(
            "attached",
            lambda: systems.attachments(
                self.series(), self.ends(), self.systems(), 12, 12, DT_H, F.col("core_area") + F.col("cold_area")
            ),
        )

    def system_series(self) -> DataFrame:
        return self.keep(
            "system_series", lambda: systems.system_series(self.series(), self.systems(), SYSTEM_AREA)
        )

    def system_pixels(self) -> DataFrame:
        def build() -> DataFrame:
            members = precip.system_features(self.system_series(), self.attached())
            return precip.system_pixels(self.cloud_pixels(), members)

        return self.keep("system_pixels", build)

    def rain_features(self) -> tuple[DataFrame, DataFrame]:
        made: dict[str, DataFrame] = {}

        def build(which: str) -> DataFrame:
            if not made:
                made["f"], made["n"] = precip.rain_features(
                    self.system_pixels(), self.ws, RAIN_MIN, RAIN_HEAVY, 100.0, PIXEL_KM, None, (self.spec.ny, self.spec.nx)
                )
            return made[which]

        return (
            self.keep("rain_features", lambda: build("f")),
            self.keep("rain_feature_counts", lambda: build("n")),
        )

    def rain_totals(self) -> DataFrame:
        return self.keep(
            "rain_totals",
            lambda: precip.rain_totals(self.system_pixels(), RAIN_MIN, RAIN_HEAVY, (90.0, 100.0)),
        )

    def assignment(self) -> DataFrame:
        return self.keep(
            "assignment", lambda: mapback.feature_assignment(self.system_series(), self.attached())
        )
