"""Section 5: upgrade path (upgrade rate from one plan, events preceding an upgrade)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_fraction, elapsed_days, id_filter, plus_days, ratio
from ..sources import Tables
from ._common import with_total

# The event types that count as upgrade triggers.
TRIGGER_EVENT_TYPES = (
    "feature_limit_hit",
    "ai_paywall_shown",
    "upgrade_cta_clicked",
    "team_invite_blocked",
    "page_limit_hit",
    "ai_trial_expired",
)
UPGRADE_PLANS = ("business", "enterprise")


def upgrade_rate(
    t: Tables,
    from_plan: str = "plus",
    upgrade_plans: tuple[str, ...] = UPGRADE_PLANS,
    benchmark_pct: float | str = "25.0",
) -> DataFrame:
    """Share of users who ever held ``from_plan`` and later started a higher plan, mean
    whole days to that upgrade, and the gap to a benchmark rate (5.1).

    The cohort is one row per user (first ``from_plan`` start). The upgrade is the first
    higher-plan start strictly after it. As only that minimum is taken, the higher-plan side
    is first reduced to distinct (user, start) by a partial aggregate, so a user with very
    many rows shrinks to their distinct starts; the two sides meet once on ``user_id`` with the
    time order as a residual predicate, and users without a later start stay in the count.
    """
    subs = t.facts("subscriptions")
    cohort = (
        subs.where((F.col("plan") == from_plan) & F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.min("start_date").alias("plus_start"))
    )
    higher = (
        subs.where(F.col("plan").isin(*upgrade_plans))
        .select(F.col("user_id").alias("h_user"), F.col("start_date").alias("up_start"))
        .distinct()
    )
    after = (F.col("user_id") == F.col("h_user")) & (F.col("up_start") > F.col("plus_start"))
    m = (
        cohort.join(higher, after, "left")
        .groupBy("user_id")
        .agg(elapsed_days(F.min("up_start"), F.min("plus_start")).alias("days_to_upgrade"))
        .agg(
            F.count("user_id").alias("total_plus_users"),
            F.count("days_to_upgrade").alias("total_upgraded"),
            F.sum("days_to_upgrade").alias("days_sum"),
            F.count("days_to_upgrade").alias("days_n"),
        )
    )
    bench = as_fraction(benchmark_pct)
    total, up = F.col("total_plus_users"), F.col("total_upgraded")
    return m.select(
        "total_plus_users",
        "total_upgraded",
        ratio(up * 100, total, 1).alias("upgrade_rate_pct"),
        ratio(F.col("days_sum"), F.col("days_n"), 0).alias("avg_days_to_upgrade"),
        (F.lit(bench.numerator).cast("double") / F.lit(float(bench.denominator))).alias(
            "industry_benchmark_pct"
        ),
        ratio(
            total * bench.numerator - up * (100 * bench.denominator),
            total * bench.denominator,
            1,
        ).alias("gap_vs_benchmark_pp"),
    )


def upgrade_triggers(
    t: Tables,
    upgrade_plans: tuple[str, ...] = UPGRADE_PLANS,
    trigger_types: tuple[str, ...] = TRIGGER_EVENT_TYPES,
    window_days: int = 7,
    top_n: int = 8,
    prefilter: bool = True,
) -> DataFrame:
    """Trigger events in the closed ``window_days`` before each user's first higher-plan
    start, counted as distinct users per (event type, feature) with their share (5.2).

    Every matching event counts (not only the last one), and the share's denominator is
    the sum of the group counts. Ties at the cut are broken by event type, then feature.

    The time-range join is an equi-join on (user, bin) for any window: the days are cut into
    bins of ``window_days`` days, so a closed window touches exactly two of them, and each user's
    first upgrade becomes two rows. Events are first reduced to one row per (user, bin, event type,
    feature) with the first and the last time. In the earlier bin the last event decides (all are
    before the window's end), in the later one the first (all are after its start), so ``last >=
    start and first <= end`` is exact. (A window of 0 days is one instant: the reduction is by the
    exact time.)

    ``prefilter`` puts a run-time filter in front of that reduction: events of users without an
    upgrade leave in the scan's stage, by a bit table of fixed size.
    """
    if window_days < 0:
        raise ValueError("window_days must not be negative")
    higher = t.facts("subscriptions").where(F.col("plan").isin(*upgrade_plans))
    first_upgrade = higher.groupBy("user_id").agg(F.min("start_date").alias("upgrade_date"))
    window_start = plus_days(F.col("upgrade_date"), -window_days)

    def bin_of(c):
        return F.floor(F.unix_date(F.to_date(c)) / F.lit(window_days)) if window_days else c

    end = bin_of(F.col("upgrade_date"))
    windows = first_upgrade.select(
        "user_id", "upgrade_date", F.explode(F.array(end - 1, end) if window_days else F.array(end)).alias("bin")
    )
    # an instant needs the events' own times, which states by day don't have
    events = t.facts("events", exact=not window_days).where(F.col("event_type").isin(*trigger_types))
    if prefilter:
        events = events.where(id_filter(higher, "user_id", F.col("user_id")))
    ev = events.groupBy(F.col("user_id").alias("e_user"), bin_of(F.col("last_at")).alias("e_bin"), "event_type", "feature_name").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
    in_window = (F.col("last_at") >= window_start) & (F.col("first_at") <= F.col("upgrade_date"))
    j = ev.join(
        windows,
        (F.col("e_user") == F.col("user_id")) & (F.col("e_bin") == F.col("bin")) & in_window,
    )
    g = j.groupBy("event_type", "feature_name").agg(
        F.count_distinct("e_user").alias("user_count")
    )
    return (
        with_total(g, "user_count")
        .select(
            F.col("event_type").alias("last_action_before_upgrade"),
            "feature_name",
            "user_count",
            ratio(F.col("user_count") * 100, F.col("total"), 1).alias("pct_of_upgrades"),
        )
        .orderBy(
            F.desc_nulls_first("user_count"),
            F.asc_nulls_last("last_action_before_upgrade"),
            F.asc_nulls_last("feature_name"),
        )
        .limit(top_n)
    )
