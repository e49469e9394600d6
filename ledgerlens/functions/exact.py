"""Exact ratio rounding shared by every analysis.

Each published percentage, average or money figure is ``ROUND(num / den, d)`` with the
numerator and denominator exact integers (counts, or money in cents). Rounding a double
would flip values that sit on a half (``201 * 100 / 20000`` is ``1.005``), so the ratio is
rounded in integer arithmetic, half away from zero, and only the final scaled integer is
turned into a DOUBLE. Everything stays a JVM expression (decimal(38,0) and ``div``), so
it runs inside whole-stage codegen.
"""

from __future__ import annotations

from fractions import Fraction
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

DEC0 = DecimalType(38, 0)


def _dec(c: Column | int) -> Column:
    if isinstance(c, int):
        return F.lit(c).cast(DEC0)
    return c.cast(DEC0)


def big(c: Column | int) -> Column:
    """Widen to decimal(38,0) before multiplying several factors: a product such as
    users x rate x cents can pass the BIGINT range at production scale."""
    return _dec(c)


def ratio_scaled(num: Column | int, den: Column | int, digits: int = 0) -> Column:
    """``round_half_away_from_zero(num * 10**digits / den)`` as a BIGINT; NULL if den is 0."""
    n = _dec(num) * _dec(10**digits)
    d = _dec(den)
    two = _dec(2)
    q = F.call_function("div", F.abs(n) * two + F.abs(d), F.abs(d) * two)
    signed = F.when((n < 0) != (d < 0), -q).otherwise(q)
    return F.when(d != 0, signed)


def scaled_to_double(q: Column, digits: int) -> Column:
    """Scaled integer back to its decimal value as DOUBLE (one correctly rounded division)."""
    return q.cast("double") / F.lit(float(10**digits))


def ratio(num: Column | int, den: Column | int, digits: int = 0) -> Column:
    """``ROUND(num / den, digits)`` computed exactly, as DOUBLE."""
    return scaled_to_double(ratio_scaled(num, den, digits), digits)


def cents(amount: Column) -> Column:
    """Money column (decimal with 2 places) as exact BIGINT cents.

    Aggregating cents as BIGINT keeps sums on the fast primitive path; decimal sums wider
    than 18 digits fall back to BigDecimal in Spark.
    """
    return (amount * F.lit(100)).cast("bigint")


def as_fraction(value: float | int | str | Decimal) -> Fraction:
    """A decimal parameter (rate, benchmark) as an exact fraction of integers."""
    return Fraction(Decimal(str(value)))
