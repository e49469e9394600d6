"""Section 6: the one-row business health dashboard."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    add_months,
    as_fraction,
    big,
    month_floor,
    month_start,
    parse_as_of,
    ratio,
    ratio_scaled,
    scaled_to_double,
    ts_lit,
)
from ..sources import Tables
from ._common import one_row


def _const(value) -> F.Column:
    fr = as_fraction(value)
    return F.lit(fr.numerator).cast("double") / F.lit(float(fr.denominator))


def health_dashboard(
    t: Tables,
    as_of: datetime | str | None = None,
    plan: str = "plus",
    free_plan: str = "free",
    plus_base: int = 7_000_000,
    annual_arpu: int = 120,
    dashboard_year: int = 2025,
    ai_feature: str = "ai_assistant",
    lookback_months: int = 1,
    status: str = "completed",
    upgrade_rate_const: float | str = "12.0",
    churn_reduction_const: float | str = "38.0",
) -> DataFrame:
    """Headline metrics in one row (6.1).

    Four independent global aggregates (users, the plan's monthly churn, revenue of one
    year, feature users of the last full month) are combined without any join and then
    turned into the final figures. The churn rate is the mean over months *with* churn
    of count / ``plus_base``; annual churn and leakage are computed from the rounded
    monthly rate, as specified. The feature adoption share counts every user with active
    use of the feature last month over active paid users, so unlike 3.1 its numerator is
    not restricted to paid or active users. The last two columns are constants.
    """
    as_of = parse_as_of(as_of)
    users = t.users.where(F.col("is_active")).agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count(F.when(F.col("plan_type") != free_plan, F.lit(1))).alias("paid_users"),
    )
    churn = (
        t.facts("churn_events")
        .where(F.col("plan") == plan)
        .groupBy(month_start(F.col("churn_date")).alias("m"))
        .agg(F.sum("rows").alias("c"))
        .agg(F.sum("c").alias("churn_rows"), F.count(F.lit(1)).alias("churn_months"))
    )
    lo, hi = datetime(dashboard_year, 1, 1), datetime(dashboard_year + 1, 1, 1)
    paid = t.facts("payments", since=lo, before=hi).where(F.col("status") == status)
    revenue = paid.agg(F.sum("rev_cents").alias("rev_cents"))
    month = month_floor(add_months(as_of, -lookback_months))
    feature_users = t.facts("feature_usage", since=month, before=add_months(month, 1)).where(
        (F.col("feature_name") == ai_feature)
        & F.col("is_active_user")
        & (F.col("month") == ts_lit(month))
    ).agg(F.count_distinct("user_id").alias("ai_users"))

    row = one_row(users, churn, revenue, feature_users)
    q = ratio_scaled(F.col("churn_rows") * 100, F.col("churn_months") * plus_base, 2)
    return row.withColumn("q", q).select(
        F.col("total_users").cast("bigint").alias("total_users"),
        F.col("paid_users").cast("bigint").alias("paid_users"),
        ratio(F.col("rev_cents"), 100 * 1_000_000, 0).alias("revenue_2025_millions"),
        scaled_to_double(F.col("q"), 2).alias("plus_monthly_churn_pct"),
        ratio(F.col("q") * 12, 100, 1).alias("plus_annual_churn_pct"),
        ratio(big(F.col("q")) * (plus_base * 12 * annual_arpu), 10_000, 0).alias(
            "annual_revenue_leakage_usd"
        ),
        ratio(F.col("ai_users") * 100, F.col("paid_users"), 1).alias(
            "ai_adoption_pct_paid_users"
        ),
        _const(upgrade_rate_const).alias("plus_to_biz_upgrade_rate_pct"),
        _const(churn_reduction_const).alias("churn_reduction_if_ai_enabled_pct"),
    )
