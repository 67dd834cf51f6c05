"""Row numbering that never sorts a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_row_number(
    df: DataFrame,
    part: Sequence[str],
    buckets: dict[str, Column],
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """``row_number() over (partition by part order by buckets, order)``.

    ``buckets`` are ascending coarse sort keys that refine into ``order``: rows
    of a lower bucket always precede rows of a higher one.  Rows are counted per
    bucket, the counts get a running sum, and only rows of one bucket are sorted
    together, so a hot partition is spread over its buckets.
    """
    part = list(part)
    names = list(buckets)
    keyed = df.withColumns(buckets)
    counts = keyed.groupBy(*part, *names).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_total(counts, part, names, "_n", "_off").drop("_n")
    local = F.row_number().over(Window.partitionBy(*part, *names).orderBy(*order))
    return (
        keyed.withColumn("_local", local)
        .join(offsets, part + names)
        .withColumn(out, (F.col("_off") + F.col("_local")).cast("long"))
        .drop("_off", "_local", *names)
    )


def running_total(
    df: DataFrame, part: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Exclusive running total of ``value`` in bucket order.

    Within a partition the buckets are few and one window does.  Without one, the
    first order column is the coarse level: its totals are accumulated first, the
    finer columns only within it.
    """
    part, order = list(part), list(order)

    def before(w) -> Column:
        return F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if part:
        return df.withColumn(out, before(Window.partitionBy(*part).orderBy(*order)))
    head, tail = order[0], order[1:]
    coarse = df.groupBy(head).agg(F.sum(value).alias(value))
    coarse = coarse.select(head, before(Window.partitionBy(F.lit(0)).orderBy(head)).alias("_base"))
    if not tail:
        return df.join(coarse, head).withColumnRenamed("_base", out)
    return (
        df.withColumn("_in", before(Window.partitionBy(head).orderBy(*tail)))
        .join(coarse, head)
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_base", "_in")
    )


def frame_index(times: DataFrame, ts: str = "ts") -> DataFrame:
    """Dense 1-based ``frame_id`` per distinct time, numbered month by month."""
    distinct = times.select(ts).where(F.col(ts).isNotNull()).distinct()
    return bucketed_row_number(distinct, [], {"_month": F.date_trunc("month", ts)}, [F.col(ts)], "frame_id")


QUANTILE_BINS = 1024


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, bins: int = QUANTILE_BINS
) -> DataFrame:
    """Exact quantile per group with linear interpolation, for groups of any size.

    Distinct values are counted first, then binned between the group's extremes;
    only the bins that hold the two neighbouring order statistics are sorted.
    """
    keys = list(keys)
    freq = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    span = freq.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = freq.join(span, keys).withColumn(
        "_b", F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width)).otherwise(0)
    )
    rank = (F.col("_n") - 1) * q
    below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        binned.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"), F.first("_n").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_bc").over(below), F.lit(0)))
        .where(
            ((F.col("_before") <= F.floor(rank)) & (F.floor(rank) < F.col("_before") + F.col("_bc")))
            | ((F.col("_before") <= F.ceil(rank)) & (F.ceil(rank) < F.col("_before") + F.col("_bc")))
        )
        .select(*keys, "_b", "_before")
    )
    within = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cells = binned.join(wanted, [*keys, "_b"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(within))

    def holds(r: Column) -> Column:
        return F.max(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r), F.col("_v")))

    picked = cells.groupBy(*keys).agg(
        holds(F.floor(rank)).alias("_a"), holds(F.ceil(rank)).alias("_z"), F.first("_n").alias("_n")
    )
    return picked.select(
        *keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * (rank - F.floor(rank))).alias(out)
    )
