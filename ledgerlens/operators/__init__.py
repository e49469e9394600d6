"""The analyses. Each is ``(tables, **params) -> DataFrame`` built from Spark's own
relational and window operators; no Python UDFs."""

from .adoption import feature_adoption, feature_stickiness, feature_usage_vs_churn
from .bitmaps import feature_adoption_bitmap, monthly_churn_rate_bitmap, platform_mix_by_region_bitmap
from .churn import (
    churn_cohort_curve,
    churn_cohort_curve_true_months,
    churn_reason_topn,
    monthly_churn_rate,
    monthly_churn_rate_active_base,
    revenue_leakage,
)
from .dashboard import health_dashboard
from .geo import platform_mix_by_region, region_revenue_arpu, top_countries
from .metrics import annual_revenue_growth, mrr_by_plan, plan_user_distribution
from .upgrade import upgrade_rate, upgrade_triggers

__all__ = [
    "feature_adoption_bitmap",
    "monthly_churn_rate_bitmap",
    "platform_mix_by_region_bitmap",
    "health_dashboard",
    "upgrade_rate",
    "upgrade_triggers",
    "platform_mix_by_region",
    "region_revenue_arpu",
    "top_countries",
    "feature_adoption",
    "feature_stickiness",
    "feature_usage_vs_churn",
    "churn_cohort_curve",
    "churn_cohort_curve_true_months",
    "churn_reason_topn",
    "monthly_churn_rate",
    "monthly_churn_rate_active_base",
    "revenue_leakage",
    "annual_revenue_growth",
    "mrr_by_plan",
    "plan_user_distribution",
]
