"""Section 3: feature adoption, feature use against churn, feature stickiness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    add_months,
    minus_days,
    month_floor,
    parse_as_of,
    plus_days,
    rank_descending,
    ratio,
    ratio_scaled,
    scaled_to_double,
    ts_lit,
)
from ..sources import Tables
from ._common import whole

# Default segment labels of the feature-vs-churn comparison.
FEATURE_SEGMENT = "AI User"
OTHER_SEGMENT = "Non-AI User"


def feature_adoption(
    t: Tables,
    as_of: datetime | str | None = None,
    lookback_months: int = 1,
    free_plan: str = "free",
    status: str = "active",
    per_user: bool = False,
) -> DataFrame:
    """Per feature, in the previous calendar month: active users, users seen, adoption
    share and mean monthly uses, over users holding an active paid subscription (3.1).

    As specified, a user with k active paid subscriptions weighs k times in the mean
    (the join fans out); ``per_user=True`` (``feature_adoption_per_user``) counts each
    user once. Both sides are reduced before the join: usage to one row per (user,
    feature) with its sums, subscriptions to one row per user with its count k, so the
    join moves one row per user and feature instead of the fan-out.
    """
    month = month_floor(add_months(parse_as_of(as_of), -lookback_months))
    g = (
        adoption_weights(t, month, free_plan, status, per_user)
        .groupBy("feature_name")
        .agg(
            F.count("active").alias("active_users"),
            F.count("user_id").alias("total_paid_users"),
            F.sum("w_sum").alias("w_sum"),
            F.sum("w_rows").alias("w_rows"),
        )
    )
    return adoption_rates(g)


def adoption_weights(t: Tables, month: datetime, free_plan: str, status: str, per_user: bool = False) -> DataFrame:
    """A row per feature and active paid subscriber that has a usage row in the month, with its
    uses and usage rows, weighted by the user's subscriptions."""
    usage = (
        t.facts("feature_usage", since=month, before=add_months(month, 1))
        .where(F.col("month") == ts_lit(month))
        .groupBy("user_id", "feature_name")
        .agg(
            F.max(F.when(F.col("is_active_user"), F.lit(1))).alias("active"),
            F.sum("usage_sum").alias("usage_sum"),
            F.sum("usage_rows").alias("usage_rows"),
        )
    )
    paid = t.facts("subscriptions").where((F.col("plan") != free_plan) & (F.col("status") == status))
    weight = F.max(F.lit(1).cast("bigint")) if per_user else F.sum("rows")
    subscribers = paid.groupBy("user_id").agg(weight.alias("k"))
    return usage.join(subscribers, "user_id").select(
        "feature_name", "user_id", "active", (F.col("usage_sum") * F.col("k")).alias("w_sum"), (F.col("usage_rows") * F.col("k")).alias("w_rows")
    )


def adoption_rates(g: DataFrame) -> DataFrame:
    """The report of 3.1 from the counts and weighted sums of each feature."""
    return g.select(
        "feature_name",
        "active_users",
        "total_paid_users",
        ratio(F.col("active_users") * 100, F.col("total_paid_users"), 1).alias(
            "adoption_rate_pct"
        ),
        ratio(F.col("w_sum"), F.col("w_rows"), 1).alias("avg_monthly_uses"),
    ).orderBy(F.desc_nulls_first("adoption_rate_pct"), F.asc_nulls_last("feature_name"))


def feature_usage_vs_churn(
    t: Tables,
    as_of: datetime | str | None = None,
    feature: str = "ai_assistant",
    segment_plan: str = "business",
    statuses: tuple[str, ...] = ("active", "churned"),
    lookback_months: int = 6,
    segment_labels: tuple[str, str] = (FEATURE_SEGMENT, OTHER_SEGMENT),
) -> DataFrame:
    """Churn rate of a plan's users who actively used one feature against the rest, and
    the relative reduction against the worst segment (3.2).

    Only distinct users matter on every side, so each input is reduced to its distinct
    user ids first; the three sets are then hash-partitioned on ``user_id`` and the two
    left joins need no further shuffle.
    """
    since = add_months(parse_as_of(as_of), -lookback_months)
    users_of_feature = (
        t.facts("feature_usage", since=since)
        .where((F.col("feature_name") == feature) & F.col("is_active_user"))
        .select("user_id")
        .distinct()
        .withColumn("uses_feature", F.lit(True))
    )
    churners = (
        t.facts("churn_events", since=since)
        .select("user_id")
        .distinct()
        .withColumn("churned", F.lit(True))
    )
    base = (
        t.facts("subscriptions")
        .where((F.col("plan") == segment_plan) & F.col("status").isin(*statuses))
        .select("user_id")
        .distinct()
    )
    j = base.join(users_of_feature, "user_id", "left").join(churners, "user_id", "left")
    segment = F.when(F.col("uses_feature"), segment_labels[0]).otherwise(segment_labels[1])
    g = j.groupBy(segment.alias("user_segment")).agg(
        F.count("user_id").alias("total_users"),
        F.count(F.when(F.col("churned"), F.col("user_id"))).alias("churned_users"),
    )
    rate = ratio_scaled(F.col("churned_users") * 100, F.col("total_users"), 2)
    g = g.withColumn("rate_scaled", rate)
    worst = F.max("rate_scaled").over(whole())
    return g.select(
        "user_segment",
        "total_users",
        "churned_users",
        scaled_to_double(F.col("rate_scaled"), 2).alias("churn_rate_pct"),
        ratio((worst - F.col("rate_scaled")) * 100, worst, 1).alias(
            "churn_reduction_vs_non_ai_pct"
        ),
    ).orderBy(F.asc_nulls_last("churn_rate_pct"), F.asc_nulls_last("user_segment"))


def feature_stickiness(
    t: Tables,
    as_of: datetime | str | None = None,
    retention_days: int = 90,
    free_plan: str = "free",
    distinct_retained: bool = False,
) -> DataFrame:
    """Features ranked by the share of their active users retained ``retention_days``
    after signup (last event at or after signup + retention_days) (3.3).

    As specified, ``retained_users`` sums the retention flag over monthly usage rows while
    ``total_users`` is distinct, so the rate can pass 100%; ``distinct_retained=True``
    (``feature_stickiness_distinct``) counts retained users once. Events are reduced to
    the last event per user before the join, usage to rows per (user, feature); ``users`` has
    one row per user (checked when it is read).
    """
    cut = minus_days(parse_as_of(as_of), retention_days)
    last_event = t.facts("events").groupBy("user_id").agg(F.max("last_at").alias("last_at"))
    eligible = t.users.where(
        (F.col("signup_date") <= ts_lit(cut)) & (F.col("plan_type") != free_plan)
    )
    kept = F.col("last_at") >= plus_days(F.col("signup_date"), retention_days)
    retention = eligible.join(last_event, "user_id", "left").select(
        "user_id", F.when(kept, 1).otherwise(0).alias("retained_90d")
    )
    usage = (
        t.facts("feature_usage")
        .where(F.col("is_active_user"))
        .groupBy("user_id", "feature_name")
        .agg(F.sum("rows").alias("rows"))
    )
    weight = F.lit(1) if distinct_retained else F.col("rows")
    # one row per (user, feature) on the one side and per user on the other
    g = (
        usage.join(retention, "user_id")
        .groupBy("feature_name")
        .agg(
            F.count("user_id").alias("total_users"),
            F.sum(F.col("retained_90d") * weight).cast("bigint").alias("retained_users"),
        )
    )
    rate = ratio_scaled(F.col("retained_users") * 100, F.col("total_users"), 1)
    ranked = rank_descending(g.withColumn("rate_scaled", rate), "rate_scaled", "stickiness_rank")
    return ranked.select(
        "feature_name",
        "total_users",
        "retained_users",
        scaled_to_double(F.col("rate_scaled"), 1).alias("retention_rate_pct"),
        "stickiness_rank",
    ).orderBy("stickiness_rank", F.asc_nulls_last("feature_name"))
