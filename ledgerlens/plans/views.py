"""Spark SQL access: the business tables and every analysis as temporary views.

    register_views(spark, tables, as_of="2025-08-01")
    spark.sql("SELECT region, arpu_usd FROM region_revenue_arpu WHERE pct_users > 10")

Each view is the analysis's DataFrame plan, so a SQL query over it is optimised together
with it (filters and column pruning flow into the analysis plan).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import TABLE_NAMES, Tables
from .registry import REGISTRY, split_overrides


def register_views(
    spark: SparkSession, t: Tables, as_of=None, prefix: str = "", **params
) -> list[str]:
    """Register ``{prefix}{table}`` for the seven tables and ``{prefix}{analysis}`` for
    every registered analysis. ``as_of`` and ``params`` go to each analysis that has them; the
    others keep their own defaults, and a name that no analysis has raises. Returns the view
    names."""
    names = []
    for name in TABLE_NAMES:
        getattr(t, name).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    given = params if as_of is None else {"as_of": as_of, **params}
    for name, p in split_overrides(list(REGISTRY), given).items():
        REGISTRY[name].on(t, **p).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
