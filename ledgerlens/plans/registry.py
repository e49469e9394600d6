"""Registry of the analyses: name -> Spark builder, oracle SQL and parameters.

Two sets of parameters are kept apart. ``variant`` belongs to an entry (it is what makes a
corrected variant another analysis). ``fixture`` is what the test tables need (a fixed instant,
their feature name, their base size) and is used by ``run``, ``on_dir`` and ``oracle_sql`` only:
the driver's queries, the bench and the tests. ``on`` is the product's way in (command line,
views): the operator's own defaults, overridden by what the caller gives.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import operators as ops
from .. import oracle
from ..sources import Tables, fixture_tables

# Fixture parameters (FIXTURES.md section 3).
AS_OF = datetime(2025, 8, 1)
AI_FEATURE = "ai_assistant"
PLUS_BASE = 1000


@dataclass(frozen=True)
class Analysis:
    name: str
    build: Callable[..., DataFrame]
    sql: Callable[..., str]
    fixture: dict[str, Any] = field(default_factory=dict)
    variant: dict[str, Any] = field(default_factory=dict)

    @property
    def params(self) -> dict[str, Any]:
        return {**self.fixture, **self.variant}

    def accepts(self, name: str) -> bool:
        """Whether a caller may set this parameter."""
        return name not in self.variant and name in list(inspect.signature(self.build).parameters)[1:]

    def on(self, tables: Tables, **overrides: Any) -> DataFrame:
        """The analysis on real tables; an unknown parameter raises."""
        unknown = [k for k in overrides if not self.accepts(k)]
        if unknown:
            raise TypeError(f"{self.name} has no parameter {', '.join(unknown)}")
        return self.build(tables, **self.variant, **overrides)

    def run(self, tables: Tables) -> DataFrame:
        return self.build(tables, **self.params)

    def oracle_sql(self) -> str:
        return self.sql(**self.params)

    def on_dir(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # the tables are listed anew for every query: files added since the last one count
        return self.run(fixture_tables(spark, sf_dir))


def split_overrides(names: list[str], given: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """The given parameters for each named analysis that has them; one that none has raises."""
    out = {n: {k: v for k, v in given.items() if REGISTRY[n].accepts(k)} for n in names}
    unused = [k for k in given if not any(k in p for p in out.values())]
    if unused:
        raise TypeError(f"no parameter of {', '.join(names)}: {', '.join(unused)}")
    return out


_VARIANT = ("per_user", "distinct_retained", "leader_nulls_first")


def _a(name: str, build: Callable[..., DataFrame], sql: Callable[..., str], **params):
    variant = {k: v for k, v in params.items() if k in _VARIANT}
    return Analysis(name, build, sql, {k: v for k, v in params.items() if k not in _VARIANT}, variant)


ANALYSES: list[Analysis] = [
    _a("plan_user_distribution", ops.plan_user_distribution, oracle.plan_user_distribution),
    _a("mrr_by_plan", ops.mrr_by_plan, oracle.mrr_by_plan),
    _a("annual_revenue_growth", ops.annual_revenue_growth, oracle.annual_revenue_growth),
    _a("monthly_churn_rate", ops.monthly_churn_rate, oracle.monthly_churn_rate, as_of=AS_OF),
    _a("churn_reason_topn", ops.churn_reason_topn, oracle.churn_reason_topn, as_of=AS_OF),
    _a("churn_cohort_curve", ops.churn_cohort_curve, oracle.churn_cohort_curve),
    _a("revenue_leakage", ops.revenue_leakage, oracle.revenue_leakage),
    _a("feature_adoption", ops.feature_adoption, oracle.feature_adoption, as_of=AS_OF),
    _a(
        "feature_usage_vs_churn",
        ops.feature_usage_vs_churn,
        oracle.feature_usage_vs_churn,
        as_of=AS_OF,
        feature=AI_FEATURE,
    ),
    _a("feature_stickiness", ops.feature_stickiness, oracle.feature_stickiness, as_of=AS_OF),
    _a("region_revenue_arpu", ops.region_revenue_arpu, oracle.region_revenue_arpu),
    _a("top_countries", ops.top_countries, oracle.top_countries),
    _a(
        "platform_mix_by_region",
        ops.platform_mix_by_region,
        oracle.platform_mix_by_region,
        as_of=AS_OF,
    ),
    _a("upgrade_rate", ops.upgrade_rate, oracle.upgrade_rate),
    _a("upgrade_triggers", ops.upgrade_triggers, oracle.upgrade_triggers),
    _a(
        "health_dashboard",
        ops.health_dashboard,
        oracle.health_dashboard,
        as_of=AS_OF,
        ai_feature=AI_FEATURE,
        plus_base=PLUS_BASE,
    ),
]

# Corrected variants of the specification's questionable semantics (separate names).
ANALYSES += [
    _a(
        "monthly_churn_rate_active_base",
        ops.monthly_churn_rate_active_base,
        oracle.monthly_churn_rate_active_base,
        as_of=AS_OF,
    ),
    _a(
        "churn_cohort_curve_true_months",
        ops.churn_cohort_curve_true_months,
        oracle.churn_cohort_curve_true_months,
        as_of=AS_OF,
    ),
    _a(
        "feature_adoption_per_user",
        ops.feature_adoption,
        oracle.feature_adoption,
        as_of=AS_OF,
        per_user=True,
    ),
    _a(
        "feature_stickiness_distinct",
        ops.feature_stickiness,
        oracle.feature_stickiness,
        as_of=AS_OF,
        distinct_retained=True,
    ),
    _a(
        "region_revenue_arpu_nulls_last",
        ops.region_revenue_arpu,
        oracle.region_revenue_arpu,
        leader_nulls_first=False,
    ),
]

# The same analyses with their counts of distinct users taken from bitmaps.
ANALYSES += [
    _a("monthly_churn_rate_bitmap", ops.monthly_churn_rate_bitmap, oracle.monthly_churn_rate, as_of=AS_OF),
    _a("feature_adoption_bitmap", ops.feature_adoption_bitmap, oracle.feature_adoption, as_of=AS_OF),
    _a("platform_mix_by_region_bitmap", ops.platform_mix_by_region_bitmap, oracle.platform_mix_by_region, as_of=AS_OF),
]

REGISTRY: dict[str, Analysis] = {a.name: a for a in ANALYSES}

# Names of the corrected variants (everything else is one of the sixteen specified analyses).
CORRECTED = frozenset(
    {
        "monthly_churn_rate_active_base",
        "churn_cohort_curve_true_months",
        "feature_adoption_per_user",
        "feature_stickiness_distinct",
        "region_revenue_arpu_nulls_last",
    }
)

BITMAP = frozenset({"monthly_churn_rate_bitmap", "feature_adoption_bitmap", "platform_mix_by_region_bitmap"})
