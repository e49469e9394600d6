"""Distinct-user counts from exact bitmaps (2.1, 3.1, 4.3).

A set of users is a bitmap per bucket of 32,768 ids. Sets of months, statuses or days are united by
``bitmap_or_agg``, intersected by ``bitmap_and_agg`` and counted by ``bitmap_count``: what is shuffled
is at most one bitmap of 4 KB per group and bucket, not one row per user, and sets stored by
month (``sources.states``) answer any span of months. The results are those of the operators of
the same name in ``churn``, ``adoption`` and ``geo``; ids should be dense (see ``states.DENSE``).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import add_months, minus_days, month_floor, parse_as_of, ts_lit
from ..sources import Tables
from ..sources.facts import USER_SETS
from .adoption import adoption_rates, adoption_weights
from .churn import monthly_rates
from .geo import platform_shares


def count_users(sets: DataFrame, *keys: str) -> DataFrame:
    """The number of users in the union of the sets of each group."""
    united = sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return united.groupBy(*keys).agg(F.sum(F.bitmap_count("users")).alias("n"))


def count_common(left: DataFrame, keys: tuple[str, ...], right: DataFrame, right_keys: tuple[str, ...] = ()) -> DataFrame:
    """The number of users in both sets, for each pair of groups with a bucket in common."""
    a = left.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("users").alias("a"))
    b = right.groupBy(*right_keys, "bucket").agg(F.bitmap_or_agg("users").alias("b"))
    both = a.join(b, "bucket").select(*keys, *right_keys, "bucket", F.explode(F.array("a", "b")).alias("users"))
    common = both.groupBy(*keys, *right_keys, "bucket").agg(F.bitmap_and_agg("users").alias("users"))
    return common.groupBy(*keys, *right_keys).agg(F.sum(F.bitmap_count("users")).alias("n"))


def monthly_churn_rate_bitmap(
    t: Tables,
    as_of: datetime | str | None = None,
    lookback_months: int = 12,
    statuses: tuple[str, ...] = ("active", "churned"),
) -> DataFrame:
    """2.1 from sets of starting and of churning users per plan and month."""
    since = add_months(month_floor(parse_as_of(as_of)), -lookback_months)
    starts = count_users(t.user_sets("starts", since).where(F.col("status").isin(*statuses)), "plan", "month")
    churned = count_users(t.user_sets("churners", since), "plan", "month")
    return monthly_rates(starts.withColumnRenamed("n", "active_users_start"), churned.withColumnRenamed("n", "churned_users"))


def feature_adoption_bitmap(
    t: Tables,
    as_of: datetime | str | None = None,
    lookback_months: int = 1,
    free_plan: str = "free",
    status: str = "active",
) -> DataFrame:
    """3.1 with its two counts from bitmaps: the month's users of each feature, met with the users
    of active paid subscriptions (united over all start months). The mean of monthly uses weighs
    quantities, which are no sets: its sums come from the facts, as in ``feature_adoption``."""
    month = month_floor(add_months(parse_as_of(as_of), -lookback_months))
    used = t.user_sets("usage_users", month, add_months(month, 1)).where(F.col("month") == ts_lit(month))
    kind = F.explode(F.array_compact(F.array(F.lit("seen"), F.when(F.col("active"), F.lit("active")))))
    used = used.select("feature_name", kind.alias("kind"), "bucket", "users")
    paid = t.user_sets("starts").where((F.col("plan") != free_plan) & (F.col("status") == status))
    met = count_common(used, ("feature_name", "kind"), paid)

    def of(k: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("bigint")

    counts = met.groupBy("feature_name").agg(of("active").alias("active_users"), of("seen").alias("total_paid_users"))
    weights = adoption_weights(t, month, free_plan, status).groupBy("feature_name").agg(
        F.sum("w_sum").alias("w_sum"), F.sum("w_rows").alias("w_rows")
    )
    same = F.col("feature_name").eqNullSafe(F.col("f"))
    j = counts.where("total_paid_users > 0").join(weights.withColumnRenamed("feature_name", "f"), same, "left")
    return adoption_rates(j)


def platform_mix_by_region_bitmap(
    t: Tables,
    as_of: datetime | str | None = None,
    lookback_days: int = 30,
    platforms: tuple[str, str] = ("mobile", "desktop"),
) -> DataFrame:
    """4.3 from sets of users per day and platform, met with the users of each region. The day in
    which the window begins is taken from the events themselves unless it begins at midnight."""
    since = minus_days(parse_as_of(as_of), lookback_days)
    midnight = since.replace(hour=0, minute=0, second=0, microsecond=0)
    days = t.user_sets("event_users", midnight if midnight == since else midnight + timedelta(days=1))
    if midnight != since:
        first = t.facts("events", since).where(F.col("last_at") < ts_lit(midnight + timedelta(days=1)))
        days = days.select("platform", "bucket", "users").unionAll(
            USER_SETS["event_users"].bitmaps(first).select("platform", "bucket", "users")
        )
    named = [F.when(F.col("platform") == p, F.lit(k)) for k, p in zip(("mobile", "desktop"), platforms, strict=True)]
    kinds = F.explode(F.array_compact(F.array(F.lit("total"), *named)))
    active = days.select(kinds.alias("kind"), "bucket", "users")
    users = F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users")
    regions = t.geo_data.where(F.col("user_id").isNotNull()).groupBy("region", F.bitmap_bucket_number("user_id").alias("bucket")).agg(users)
    met = count_common(active, ("kind",), regions, ("region",))

    def of(k: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("bigint").alias(f"{k}_users")

    return platform_shares(met.groupBy("region").agg(*[of(k) for k in ("mobile", "desktop", "total")]).where("total_users > 0"))
