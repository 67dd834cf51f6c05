"""The entry works in a session of its own, started from another folder, with workers that do not see this one."""

from __future__ import annotations

import os
import subprocess
import sys

from tests.conftest import ROOT

SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
print("ROWS", entry.queries()["label_components"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, os.path.join(ROOT, "__spark_entry__.py"), f"file://{tmp_path}/shared"],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240,
    )
    assert "ROWS" in done.stdout, done.stderr[-2000:]
    assert int(done.stdout.split("ROWS")[1]) > 0
