"""Calendar helpers on TIMESTAMP_NTZ columns (the reference's TIMESTAMP without zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_start(ts) -> Column:
    """DATE_TRUNC('month', ts) kept as TIMESTAMP_NTZ (F1)."""
    return F.trunc(_c(ts).cast("date"), "month").cast("timestamp_ntz")


def month_index(ts) -> Column:
    """year * 12 + month; differences of it are DATE_PART month arithmetic."""
    t = _c(ts)
    return F.year(t) * 12 + F.month(t)


def months_apart(later, earlier) -> Column:
    """(y2-y1)*12 + (m2-m1) as INT: calendar months, not months_between."""
    return (month_index(later) - month_index(earlier)).cast("int")


def year_month_text(ts) -> Column:
    """TO_CHAR(ts, 'YYYY-MM')."""
    return F.date_format(_c(ts), "yyyy-MM")


def fractional_days(end, start) -> Column:
    """EXTRACT(EPOCH FROM end - start) / 86400.0, signed."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / F.lit(MICROS_PER_DAY)


def minus_days(ts, days: int) -> Column:
    """ts - INTERVAL 'n days' (F6)."""
    return _c(ts) - F.make_dt_interval(F.lit(days))


def weekday_monday0(ts) -> Column:
    """pandas dt.dayofweek: Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def is_weekend(ts) -> Column:
    """dayofweek >= 5 as 0/1 (F13); 0 without a time."""
    return F.coalesce(weekday_monday0(ts) >= 5, F.lit(False)).cast("int")
