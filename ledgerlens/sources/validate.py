"""Load-time checks of the business tables.

The analyses assume one ``users`` row and one ``geo_data`` row per user: a duplicated
geography row multiplies that user's revenue in the regional reports, exactly as the
specification's SQL would. The readers check this when a table is first used, with one distributed
aggregate; the report of ``check_unique_keys`` is a DataFrame of all offending keys.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .tables import Tables

# Tables whose key is expected to be unique, and the key.
UNIQUE_KEYS = {"users": ("user_id",), "geo_data": ("user_id",)}


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def check_unique_keys(t: Tables) -> dict[str, DataFrame]:
    """For each table of ``UNIQUE_KEYS``, all its duplicated keys (no rows if none)."""
    return {name: duplicate_keys(getattr(t, name), keys) for name, keys in UNIQUE_KEYS.items()}


def require_unique(name: str, df: DataFrame) -> DataFrame:
    """``df``, after one aggregate has shown that its key is unique; raises otherwise. Tables
    without a declared key pass."""
    keys = UNIQUE_KEYS.get(name)
    if keys:
        found = duplicate_keys(df, keys).agg(F.count(F.lit(1)), F.sum("rows"), F.min(keys[0])).first()
        if found[0]:
            raise ValueError(
                f"table {name!r}: {found[0]} values of {', '.join(keys)} occur {found[1]} times, "
                f"{found[2]} among them; sources.duplicate_keys lists all; duplicates='ignore' reads on"
            )
    return df
