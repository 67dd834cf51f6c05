"""Nearest match in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_in_time(
    rows: DataFrame,
    candidates: DataFrame,
    ids: Sequence[str],
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    tolerance_s: float,
) -> DataFrame:
    """(ids, values): for each row the candidate with its ``keys`` that is nearest in ``time`` (seconds).

    Candidates ``tolerance_s`` away or farther do not count; of equally near ones the first in the order of
    ``values`` is taken, so put what identifies a candidate first.  Rows without a match, a key or a time are left
    out.  ``ids`` must name each row.

    Times are cut into spans twice as long as the tolerance, so a match lies in the row's span or one beside it:
    an equi-join on (keys, span) in which only the rows are repeated, three times each.
    """
    if not tolerance_s > 0:
        raise ValueError("the tolerance must be more than 0 seconds")

    def span(col: str):
        return F.floor(F.col(col).cast("double") / (2.0 * tolerance_s))

    here = rows.select(*ids, *keys, F.col(time).cast("double").alias("_t")).withColumn(
        "_span", F.explode(F.sequence(span("_t") - 1, span("_t") + 1))
    )
    there = candidates.select(*keys, F.col(time).cast("double").alias("_u"), F.struct(*values).alias("_v")).withColumn(
        "_span", span("_u")
    )
    gap = F.abs(F.col("_t") - F.col("_u"))
    return (
        here.join(there, [*keys, "_span"])
        .where(gap < tolerance_s)
        .groupBy(*ids)
        .agg(F.min(F.struct(gap.alias("gap"), "_v")).alias("_best"))
        .select(*ids, *[F.col(f"_best._v.{v}").alias(v) for v in values])
    )
