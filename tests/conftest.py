from __future__ import annotations

import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from driftfield.session import local_session  # noqa: E402
from driftfield.workspace import Workspace  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ws(spark, tmp_path_factory):
    return Workspace(spark, str(tmp_path_factory.mktemp("ws")))


def drawn(spark, frames: list[list[str]], digits: bool = False):
    """(frame_id, y, x[, feature_id]) from drawings; '.' is background, characters are labels."""
    rows = []
    for f, lines in enumerate(frames, start=1):
        for y, line in enumerate(lines):
            for x, c in enumerate(line):
                if c != ".":
                    rows.append((f, y, x, int(c) if digits else 1))
    pdf = pd.DataFrame(rows, columns=["frame_id", "y", "x", "feature_id"])
    df = spark.createDataFrame(pdf, "frame_id long, y int, x int, feature_id int")
    return df if digits else df.drop("feature_id")


def clock(spark, hours: list[float]):
    rows = [(i, int(h * 3600)) for i, h in enumerate(hours, start=1)]
    return spark.createDataFrame(rows, "frame_id long, epoch_s long")
