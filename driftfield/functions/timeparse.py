"""Times from strings and file names, and calendar conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compact_epoch(text: Column | str) -> Column:
    """Epoch seconds of a ``yyyymmdd.hhmm`` string (UTC session time zone)."""
    return F.unix_timestamp(F.to_timestamp(_col(text), "yyyyMMdd.HHmm"))


def name_time(path: Column | str, base: str, pattern: str) -> Column:
    """Timestamp at fixed positions of a file name, after its base name.

    ``pattern`` uses yyyy/yodd style letters: y year, o month, d day, h hour, m
    minute, s second; any other letter is skipped.  Missing month and day become
    1, missing hours, minutes and seconds 0.
    """
    name = F.element_at(F.split(_col(path), "/"), -1)
    tail = F.substring(name, len(base) + 1, len(pattern))

    def part(letter: str, default: int) -> Column:
        spots = [i for i, c in enumerate(pattern) if c == letter]
        if not spots:
            return F.lit(default)
        return F.concat(*[F.substring(tail, i + 1, 1) for i in spots]).cast("int")

    return F.make_timestamp(
        part("y", 1970), part("o", 1), part("d", 1), part("h", 0), part("m", 0), part("s", 0).cast("decimal(8,6)")
    )


def calendar_time(year, month, day, hour, minute, second) -> Column:
    """Standard timestamp with the same components; impossible dates (30 February) are NULL."""
    parts = [_col(c) for c in (year, month, day, hour, minute)]
    valid = parts[2] <= F.dayofmonth(F.last_day(F.make_date(parts[0], parts[1], F.lit(1))))
    return F.when(valid, F.make_timestamp(*parts[:2], F.least(parts[2], F.lit(28)), *parts[3:], _col(second))
                  + F.make_dt_interval(F.greatest(parts[2] - 28, F.lit(0))))


def round_to_second(ts: Column | str) -> Column:
    return F.timestamp_seconds(F.round(F.unix_micros(_col(ts).cast("timestamp")) / 1e6))
