"""Section 4: geography (revenue and ARPU by region, top countries, platform mix)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import big, minus_days, parse_as_of, ratio
from ..sources import Tables
from ._common import total_over_groups


def _revenue_per_user(t: Tables, status: str) -> DataFrame:
    """Completed payments reduced to one row per user (cents and row count) before any
    join: SUM and AVG-as-sum/count are additive, so the star join carries one row per
    user instead of one per payment, and a user with a huge number of payments is
    collapsed by the map-side partial aggregate."""
    return (
        t.facts("payments")
        .where(F.col("status") == status)
        .groupBy("user_id")
        .agg(F.sum("rev_cents").alias("rev_cents"), F.sum("pay_rows").alias("pay_rows"))
    )


def _active_users_with_geo(t: Tables, *geo_cols: str) -> DataFrame:
    """Active users with their geography; ``users.country`` is not used (geography comes
    from ``geo_data``)."""
    u = t.users.where(F.col("is_active")).select("user_id", "plan_type")
    return u.join(t.geo_data.select("user_id", *geo_cols), "user_id")


def region_revenue_arpu(
    t: Tables, status: str = "completed", leader_nulls_first: bool = True
) -> DataFrame:
    """Active users, completed revenue, their shares, ARPU and the gap to the highest
    ARPU, per region (4.1).

    The leader is the first region by ARPU descending. With ``leader_nulls_first`` (the
    specification's ordering) a region without any payment has NULL ARPU, sorts first,
    and makes every gap NULL; ``False`` (``region_revenue_arpu_nulls_last``) skips it.
    Shares and the leader are windows over the per-region result (a handful of rows).
    """
    j = _active_users_with_geo(t, "region").join(
        _revenue_per_user(t, status), "user_id", "left"
    )
    g = j.groupBy("region").agg(
        F.count_distinct("user_id").alias("total_users"),
        F.sum("rev_cents").alias("rev_cents"),
    )
    arpu_key = F.try_divide(F.col("rev_cents").cast("double"), F.col("total_users").cast("double"))
    order = F.desc_nulls_first if leader_nulls_first else F.desc_nulls_last
    by_arpu = Window.orderBy(order(arpu_key), F.asc_nulls_last("region"))
    lead_rev = F.first("rev_cents").over(by_arpu)
    lead_users = F.first("total_users").over(by_arpu)
    users, rev = F.col("total_users"), F.col("rev_cents")
    gap = ratio(
        big(rev) * lead_users - big(lead_rev) * users, big(users) * lead_users * 100, 0
    )
    return g.select(
        "region",
        "total_users",
        ratio(users * 100, total_over_groups("total_users"), 1).alias("pct_users"),
        ratio(rev, 100 * 1_000_000, 1).alias("revenue_millions"),
        ratio(big(rev) * 100, total_over_groups("rev_cents"), 1).alias("pct_revenue"),
        ratio(rev, users * 100, 0).alias("arpu_usd"),
        gap.alias("arpu_gap_vs_leader"),
    ).orderBy(F.desc_nulls_first("revenue_millions"), F.asc_nulls_last("region"))


def top_countries(
    t: Tables, status: str = "completed", free_plan: str = "free", top_n: int = 10
) -> DataFrame:
    """Top countries by active users: paid users, paid conversion and mean completed
    payment (4.2). Ties at the cut are broken by country, then region.

    Two-level aggregation instead of two COUNT DISTINCTs: the join output is already
    partitioned by ``user_id``, so grouping by (country, region, user) needs no shuffle,
    and the second level is a plain count over a few hundred groups.
    """
    j = _active_users_with_geo(t, "country", "region").join(
        _revenue_per_user(t, status), "user_id", "left"
    )
    per_user = j.groupBy("country", "region", "user_id").agg(
        F.max(F.col("plan_type") != free_plan).alias("paid"),
        F.sum("rev_cents").alias("rev_cents"),
        F.sum("pay_rows").alias("pay_rows"),
    )
    g = per_user.groupBy("country", "region").agg(
        F.count("user_id").alias("total_users"),
        F.count(F.when(F.col("paid"), F.lit(1))).alias("paid_users"),
        F.sum("rev_cents").alias("rev_cents"),
        F.sum("pay_rows").alias("pay_rows"),
    )
    return (
        g.select(
            "country",
            "region",
            "total_users",
            "paid_users",
            ratio(F.col("paid_users") * 100, F.col("total_users"), 1).alias(
                "paid_conversion_pct"
            ),
            ratio(F.col("rev_cents"), F.col("pay_rows") * 100, 2).alias("avg_payment_usd"),
        )
        .orderBy(
            F.desc_nulls_first("total_users"),
            F.asc_nulls_last("country"),
            F.asc_nulls_last("region"),
        )
        .limit(top_n)
    )


def platform_mix_by_region(
    t: Tables,
    as_of: datetime | str | None = None,
    lookback_days: int = 30,
    platforms: tuple[str, str] = ("mobile", "desktop"),
) -> DataFrame:
    """Users active on mobile, on desktop, and in total per region over the last
    ``lookback_days`` (4.3). A user can count on both platforms, and a NULL or other
    platform counts only in the total, so the two shares need not add to 100.

    Events are reduced to per-user platform flags before the join (one row per user).
    """
    since = minus_days(parse_as_of(as_of), lookback_days)
    mobile, desktop = platforms
    flags = (
        t.facts("events", since=since)
        .groupBy("user_id")
        .agg(
            F.max(F.when(F.col("platform") == mobile, F.lit(1))).alias("m"),
            F.max(F.when(F.col("platform") == desktop, F.lit(1))).alias("d"),
        )
    )
    per_user = (
        flags.join(t.geo_data.select("user_id", "region"), "user_id")
        .groupBy("region", "user_id")
        .agg(F.max("m").alias("m"), F.max("d").alias("d"))
    )
    g = per_user.groupBy("region").agg(
        F.count("m").alias("mobile_users"),
        F.count("d").alias("desktop_users"),
        F.count("user_id").alias("total_users"),
    )
    return platform_shares(g)


def platform_shares(g: DataFrame) -> DataFrame:
    """The report of 4.3 from the three counts of each region."""
    return g.select(
        "region",
        "mobile_users",
        "desktop_users",
        "total_users",
        ratio(F.col("mobile_users") * 100, F.col("total_users"), 1).alias("mobile_pct"),
        ratio(F.col("desktop_users") * 100, F.col("total_users"), 1).alias("desktop_pct"),
    ).orderBy(F.desc_nulls_first("mobile_pct"), F.asc_nulls_last("region"))
