"""Small relational building blocks shared by the analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole():
    """A window over the whole (already aggregated) result.

    Only used after a groupBy whose keys the business fixes (plans, years, regions, features),
    so the single-partition window sees tens of rows whatever the size of the input tables. Groups
    by free text take ``total`` instead.
    """
    return Window.partitionBy()


def total_over_groups(c: str | Column) -> Column:
    """``SUM(c) OVER ()`` on a grouped result."""
    return F.sum(c).over(whole())


def with_total(groups: DataFrame, c: str) -> DataFrame:
    """A grouped result with ``total``, ``SUM(c)`` over all groups, as a column bound once: a
    scalar subquery, so the groups may be many and no task gets them all. Its aggregate is the one
    of ``groups``, run once (reused)."""
    return groups.withColumn("total", groups.select(F.sum(c)).scalar())


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row global aggregates with disjoint columns into a single row.

    Each input is a global ``agg`` (exactly one row). They are unioned by name, every
    other column NULL, and collapsed by one more global aggregate, so there is no join
    at all; the union holds as many rows as there are inputs.
    """
    columns: list[str] = []
    for f in frames:
        columns.extend(c for c in f.columns if c not in columns)
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
