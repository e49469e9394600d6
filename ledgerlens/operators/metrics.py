"""Section 1: key metrics snapshot (plan mix, MRR by plan, annual revenue growth)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..sources import Tables
from ._common import total_over_groups


def plan_user_distribution(t: Tables, active_only: bool = True) -> DataFrame:
    """Active users per plan and their share of all active users (1.1)."""
    u = t.users
    if active_only:
        u = u.where(F.col("is_active"))
    g = u.groupBy("plan_type").agg(F.count("user_id").alias("total_users"))
    return g.select(
        "plan_type",
        "total_users",
        ratio(F.col("total_users") * 100, total_over_groups("total_users"), 1).alias(
            "pct_of_total"
        ),
    ).orderBy(F.desc_nulls_first("total_users"), F.asc_nulls_last("plan_type"))


def mrr_by_plan(t: Tables, free_plan: str = "free", status: str = "active") -> DataFrame:
    """Paying users, total/average MRR and MRR share per paid plan (1.2).

    ``paying_users`` counts distinct users while ``avg_mrr_per_user`` averages
    subscription rows, as specified.
    """
    s = t.facts("subscriptions").where((F.col("status") == status) & (F.col("plan") != free_plan))
    g = s.groupBy("plan").agg(
        F.count_distinct("user_id").alias("paying_users"),
        F.sum("mrr_cents").alias("mrr_cents"),
        F.sum("mrr_rows").alias("mrr_rows"),
    )
    return g.select(
        "plan",
        "paying_users",
        ratio(F.col("mrr_cents"), 100, 0).alias("total_mrr"),
        ratio(F.col("mrr_cents"), F.col("mrr_rows") * 100, 2).alias("avg_mrr_per_user"),
        ratio(F.col("mrr_cents") * 100, total_over_groups("mrr_cents"), 1).alias(
            "pct_of_total_mrr"
        ),
    ).orderBy(F.desc_nulls_first("total_mrr"), F.asc_nulls_last("plan"))


def annual_revenue_growth(
    t: Tables, year_from: int = 2019, year_to: int = 2025, status: str = "completed"
) -> DataFrame:
    """Completed revenue per calendar year, the previous year and year-over-year growth (1.3).

    The year test is a half-open timestamp range, so it reaches the Parquet scan as a
    pushed filter (``EXTRACT(YEAR)`` would not). ``prev_year_revenue`` lags the rounded
    millions; growth uses the unrounded sums. A missing year is skipped, not zero-filled.
    """
    lo, hi = datetime(year_from, 1, 1), datetime(year_to + 1, 1, 1)
    p = t.facts("payments", since=lo, before=hi).where(F.col("status") == status)
    g = p.groupBy(F.year("paid_at").cast("bigint").alias("revenue_year")).agg(
        F.sum("rev_cents").alias("rev_cents")
    )
    by_year = Window.orderBy("revenue_year")
    millions = ratio(F.col("rev_cents"), 100 * 1_000_000, 1)
    prev = F.lag("rev_cents").over(by_year)
    return g.select(
        "revenue_year",
        millions.alias("revenue_millions_usd"),
        F.lag(millions).over(by_year).alias("prev_year_revenue"),
        ratio((F.col("rev_cents") - prev) * 100, prev, 1).alias("yoy_growth_pct"),
    ).orderBy("revenue_year")
