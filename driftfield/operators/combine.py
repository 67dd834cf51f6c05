"""Tables of several runs as one, with track numbers that do not collide.

Every run gets a block of numbers: its own numbers moved by the highest numbers
of the runs before it.  Only one maximum per run passes through the driver; rows
are moved by a projection, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTERS = ("track_id", "merge_track", "split_track")


def id_blocks(runs: Mapping[str, DataFrame], pointers: Sequence[str] = POINTERS) -> dict[str, int]:
    """What each run's numbers are moved by, in the order of ``runs``.

    A block is as long as the highest number in any pointer column, since a pointer
    may name a track that the table itself no longer holds.
    """
    shifts, used = {}, 0
    for name, df in runs.items():
        shifts[name] = used
        present = [c for c in pointers if c in df.columns]
        if present:
            top = df.agg(*[F.max(c).alias(c) for c in present]).first()
            used += max((v for v in top if v is not None), default=0)
    return shifts


def combine_runs(
    runs: Mapping[str, DataFrame],
    shifts: Mapping[str, int] | None = None,
    pointers: Sequence[str] = POINTERS,
    run: str = "run",
) -> DataFrame:
    """All runs' rows with the run's name in ``run``; every pointer column follows the run's block.

    ``shifts`` from :func:`id_blocks` keeps several tables of the same runs (series, ends, pixels)
    in step; without it the blocks are those of the tables given.  NULL pointers stay NULL, columns
    that only some runs have are NULL in the others.  A run without rows takes no numbers.
    """
    if not runs:
        raise ValueError("no run to combine")
    for name, df in runs.items():
        if run in df.columns:
            raise ValueError(f"run '{name}' already has a column '{run}'")
    shifts = id_blocks(runs, pointers) if shifts is None else shifts

    def moved(name: str, df: DataFrame) -> DataFrame:
        present = [c for c in pointers if c in df.columns]
        return df.withColumns({c: F.col(c).cast("long") + F.lit(shifts[name]) for c in present} | {run: F.lit(name)})

    parts = [moved(name, df) for name, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
