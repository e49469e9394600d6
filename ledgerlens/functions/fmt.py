"""Output formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dollars(whole: Column) -> Column:
    """``'$' || TO_CHAR(n, 'FM999,999,999')`` for a whole number: ``$1,234,567``.

    NULL stays NULL. Unlike the fixed nine-digit mask, ten or more digits print in full.
    """
    return F.concat(F.lit("$"), F.format_number(whole.cast("bigint"), 0))


def year_month(c: Column) -> Column:
    """``TO_CHAR(ts, 'YYYY-MM')``."""
    return F.date_format(c, "yyyy-MM")
