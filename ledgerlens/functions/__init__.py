"""Column-expression helpers (all JVM built-ins; no Python UDFs)."""

from .exact import as_fraction, big, cents, ratio, ratio_scaled, scaled_to_double
from .fmt import dollars, year_month
from .prefilter import id_filter
from .ranking import rank_descending
from .timeutil import (
    add_months,
    elapsed_days,
    minus_days,
    month_component_of_age,
    month_floor,
    month_start,
    months_between_starts,
    parse_as_of,
    plus_days,
    plus_months,
    sql_ts,
    ts_lit,
)

__all__ = [
    "add_months",
    "as_fraction",
    "big",
    "cents",
    "dollars",
    "elapsed_days",
    "id_filter",
    "minus_days",
    "month_component_of_age",
    "month_floor",
    "month_start",
    "months_between_starts",
    "parse_as_of",
    "plus_days",
    "plus_months",
    "rank_descending",
    "ratio",
    "ratio_scaled",
    "scaled_to_double",
    "sql_ts",
    "ts_lit",
    "year_month",
]
