"""Written stage tables.

Iterative operators and stage boundaries cut their lineage by writing Parquet
below the shared folder named by ``spark.checkpoint.dir``.  A lost executor
therefore never loses a stage, and the size of each stage is known to the
optimizer when it picks broadcast or shuffle joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


class Workspace:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        root = root or spark.conf.get(CHECKPOINT_KEY, None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
            root = tempfile.mkdtemp(prefix="driftfield-")
        self.base = f"{root.rstrip('/')}/driftfield-{uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        """A folder that nothing else uses, as a URI."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:12]}"
        return path if "://" in path or path.startswith("file:") else f"file://{path}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete every table this workspace wrote."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_open: dict[str, Workspace] = {}


def workspace_for(spark: SparkSession) -> Workspace:
    """One workspace per Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _open:
        _open[app] = Workspace(spark)
    return _open[app]
