"""Headline stages on the driver's tables; prints one JSON line.

``queries`` are cold runs: remembered stages are dropped before each of them, so a
query pays for everything it needs.  ``stages`` time the tracking plan step by
step on a finer field (weekly frames, 100 x 200 pixels) and give its throughput
in grid pixels per second, the unit the published numbers can be compared in.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import registry  # noqa: E402
from catalog.stages import FieldSpec, Stages, forget_stages  # noqa: E402
from driftfield.session import local_session  # noqa: E402

QUERIES = (
    "gridded_field",
    "sort_renumber",
    "link_overlap",
    "track_points",
    "track_attributes",
    "identify_systems",
    "rain_features",
    "map_pixels",
    "classify_echo",
    "echo_top_heights",
    "monthly_rain_map",
)
FINE = FieldSpec("week", 100, 200, 8)
STEPS = ("frames", "field", "regions", "features", "labels", "links", "points", "cloud_pixels", "feature_stats", "all_series", "series")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["start_end_time"](spark, sf_dir).collect()

    queries = {}
    for name in QUERIES:
        forget_stages()
        begin = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        queries[name] = round(time.time() - begin, 3)

    forget_stages()
    stages = Stages(spark, sf_dir, FINE)
    timed = {}
    for step in STEPS:
        begin = time.time()
        getattr(stages, step)()
        timed[step] = round(time.time() - begin, 3)
    pixels = stages.frames().count() * FINE.ny * FINE.nx
    tracking = sum(timed[s] for s in STEPS if s not in ("frames", "field"))
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "stages": timed,
                "grid_pixels": pixels,
                "field_rows": stages.field().count(),
                "label_rows": stages.labels().count(),
                "tracking_mpx_per_s": round(pixels / tracking / 1e6, 4),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
