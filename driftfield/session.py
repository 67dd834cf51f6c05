"""Session helpers. On a cluster the session is supplied by the platform."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(app: str = "driftfield", cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


PACKAGES = ("driftfield", "catalog")
_shipped: set[str] = set()


def ship_packages(spark: SparkSession, root: str, packages: tuple[str, ...] = PACKAGES) -> None:
    """Send the packages below ``root`` to the executors, once per Spark application.

    Kernels are pickled by reference, so workers must be able to import them
    wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="driftfield-code-"), "driftfield_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as code:
        for package in packages:
            for folder, _, names in os.walk(os.path.join(root, package)):
                for name in names:
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        code.write(file, os.path.relpath(file, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
