"""Time helpers: the ``as_of`` instant, literal bounds and month arithmetic.

All business timestamps are TIMESTAMP_NTZ (wall-clock, no zone). Bounds derived from
``as_of`` are computed once on the driver and enter the plan as literals, so Catalyst
pushes them into the Parquet scan as ``PushedFilters``.
"""

from __future__ import annotations

import calendar
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_as_of(as_of: datetime | str | None) -> datetime:
    """The evaluation instant as a wall-clock time in UTC: the time of the call when not
    given; an instant with an offset is converted."""
    if as_of is None:
        as_of = datetime.now(timezone.utc)
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    return as_of.astimezone(timezone.utc).replace(tzinfo=None) if as_of.tzinfo else as_of


def add_months(ts: datetime, months: int) -> datetime:
    """Calendar month shift; the day is clamped to the end of a shorter month."""
    total = ts.year * 12 + (ts.month - 1) + months
    year, month0 = divmod(total, 12)
    day = min(ts.day, calendar.monthrange(year, month0 + 1)[1])
    return ts.replace(year=year, month=month0 + 1, day=day)


def month_floor(ts: datetime) -> datetime:
    return ts.replace(day=1, hour=0, minute=0, second=0, microsecond=0)


def minus_days(ts: datetime, days: int) -> datetime:
    return ts - timedelta(days=days)


def ts_lit(ts: datetime) -> Column:
    """A TIMESTAMP_NTZ literal (string cast, so no time zone is involved)."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def sql_ts(ts: datetime) -> str:
    """The same literal in SQL text, for the oracle."""
    return f"TIMESTAMP '{ts.isoformat(sep=' ')}'"


def month_start(c: Column) -> Column:
    """``DATE_TRUNC('month', c)`` kept as TIMESTAMP_NTZ, independent of the session zone."""
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def plus_days(c: Column, days: int | Column) -> Column:
    n = F.lit(days) if isinstance(days, int) else days
    return c + F.make_dt_interval(days=n)


def plus_months(c: Column, months: int | Column) -> Column:
    n = F.lit(months) if isinstance(months, int) else months
    return c + F.make_ym_interval(F.lit(0), n)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days, ``EXTRACT(DAY FROM later - earlier)``."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def month_component_of_age(later_month: Column, earlier_month: Column) -> Column:
    """``EXTRACT(MONTH FROM AGE(a, b))`` for two month starts: the month part of the
    difference, in -11..11 with the sign of the difference (13 months gives 1)."""
    total = (F.year(later_month) - F.year(earlier_month)) * 12 + (
        F.month(later_month) - F.month(earlier_month)
    )
    return (total % 12).cast("bigint")


def months_between_starts(later_month: Column, earlier_month: Column) -> Column:
    """Total whole months between two month starts (no wrap)."""
    return (
        (F.year(later_month) - F.year(earlier_month)) * 12
        + (F.month(later_month) - F.month(earlier_month))
    ).cast("bigint")
