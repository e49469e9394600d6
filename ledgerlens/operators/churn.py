"""Section 2: churn (monthly rate, reasons, signup-cohort curve, revenue leakage)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    add_months,
    as_fraction,
    big,
    dollars,
    month_component_of_age,
    month_floor,
    month_start,
    months_between_starts,
    parse_as_of,
    plus_months,
    ratio,
    ratio_scaled,
    ts_lit,
    year_month,
)
from ..sources import Tables
from ._common import with_total


def _monthly_churners(t: Tables, since: datetime) -> DataFrame:
    """Distinct churning users per (plan, churn month), churn months from ``since`` on."""
    c = t.facts("churn_events", since=since)
    return c.groupBy("plan", month_start(F.col("churn_date")).alias("month")).agg(
        F.count_distinct("user_id").alias("churned_users")
    )


def monthly_churn_rate(
    t: Tables,
    as_of: datetime | str | None = None,
    lookback_months: int = 12,
    statuses: tuple[str, ...] = ("active", "churned"),
) -> DataFrame:
    """Per plan and start month: users starting, users churning that month, ratio (2.1).

    ``active_users_start`` counts users whose subscription *started* in the month (see
    ``monthly_churn_rate_active_base`` for the active-base denominator). Months are kept
    from ``month(as_of) - lookback_months`` on, with no upper bound. Because the bound is
    a month start, the month test is a plain range on the raw timestamps and prunes both
    scans; churn months before the bound could never join.
    """
    since = add_months(month_floor(parse_as_of(as_of)), -lookback_months)
    s = t.facts("subscriptions", since=since).where(F.col("status").isin(*statuses))
    starts = s.groupBy("plan", month_start(F.col("start_date")).alias("month")).agg(
        F.count_distinct("user_id").alias("active_users_start")
    )
    return monthly_rates(starts, _monthly_churners(t, since))


def monthly_rates(starts: DataFrame, churners: DataFrame) -> DataFrame:
    """The report of 2.1 from users per (plan, month): starting ones and churning ones."""
    j = starts.join(churners, ["plan", "month"], "left")
    churned = F.coalesce(F.col("churned_users"), F.lit(0)).cast("bigint")
    return j.orderBy(F.asc_nulls_last("plan"), F.asc_nulls_last("month")).select(
        "plan",
        year_month(F.col("month")).alias("month"),
        "active_users_start",
        churned.alias("churned_users"),
        ratio(churned * 100, F.col("active_users_start"), 2).alias("monthly_churn_pct"),
    )


def monthly_churn_rate_active_base(
    t: Tables,
    as_of: datetime | str | None = None,
    lookback_months: int = 12,
    statuses: tuple[str, ...] = ("active", "churned"),
) -> DataFrame:
    """Corrected 2.1: the denominator is the base active at the start of each month.

    A subscription counts in month M when it started before M and had not ended before M
    (``end_date`` NULL or ``>= M``). Each subscription is an interval of window months; a
    (plan, user)'s distinct intervals are gathered by a partial plus final aggregate (a user
    with many subscriptions collapses map-side; there are at most as many intervals as pairs
    of window months), turned into distinct months, and counted. Churners as in 2.1; a month
    with churners but no active base is kept with a NULL rate.
    """
    first = add_months(month_floor(parse_as_of(as_of)), -lookback_months)
    n_months = lookback_months + 1
    last = add_months(first, lookback_months)
    s = t.facts("subscriptions", before=last).where(F.col("status").isin(*statuses)).where(
        F.col("end_date").isNull() | (F.col("end_date") >= ts_lit(first)))
    # Window months M_k = first + k months with start_date < M_k <= end_date (or no end).
    # For a month start M: start_date < M  <=>  M >= month(start_date) + 1 month, and
    # M <= end_date  <=>  M <= month(end_date).
    lo = F.greatest(
        months_between_starts(month_start(F.col("start_date")), ts_lit(first)) + F.lit(1),
        F.lit(0),
    )
    hi_end = months_between_starts(month_start(F.col("end_date")), ts_lit(first))
    hi = F.least(F.coalesce(hi_end, F.lit(n_months - 1)), F.lit(n_months - 1))
    spans = (
        s.where(F.col("user_id").isNotNull())
        .select("plan", "user_id", F.struct(lo.alias("lo"), hi.alias("hi")).alias("span"))
        .where("span.lo <= span.hi")
    )
    per_user = spans.groupBy("plan", "user_id").agg(F.collect_set("span").alias("spans"))
    months = F.flatten(F.transform("spans", lambda x: F.sequence(x["lo"], x["hi"])))
    covered = per_user.select("plan", F.explode(F.array_distinct(months)).alias("k"))
    base = covered.groupBy("plan", "k").agg(F.count(F.lit(1)).alias("active_base"))
    base = base.select(
        "plan", plus_months(ts_lit(first), F.col("k").cast("int")).alias("month"), "active_base"
    )
    churn = _monthly_churners(t, first).where(F.col("month") < ts_lit(add_months(last, 1)))
    j = base.join(churn, ["plan", "month"], "full")
    churned = F.coalesce(F.col("churned_users"), F.lit(0)).cast("bigint")
    # a NULL plan matches nothing, so its base and its churners are two rows of one month
    return j.orderBy(
        F.asc_nulls_last("plan"), F.asc_nulls_last("month"), F.desc_nulls_last("active_base")
    ).select(
        "plan",
        year_month(F.col("month")).alias("month"),
        F.coalesce(F.col("active_base"), F.lit(0)).cast("bigint").alias("active_base"),
        churned.alias("churned_users"),
        ratio(churned * 100, F.col("active_base"), 2).alias("monthly_churn_pct"),
    )


def churn_reason_topn(
    t: Tables,
    as_of: datetime | str | None = None,
    plan: str = "plus",
    lookback_months: int = 6,
    top_n: int = 8,
) -> DataFrame:
    """Top churn reasons of one plan since ``as_of - lookback_months`` (2.2).

    The share is over all reasons, computed before the cut; ties at the cut are broken
    by reason so the result is deterministic.
    """
    since = add_months(parse_as_of(as_of), -lookback_months)
    c = t.facts("churn_events", since=since).where(F.col("plan") == plan)
    g = c.groupBy("churn_reason").agg(F.sum("rows").alias("churn_count"))
    return (
        with_total(g, "churn_count")
        .select(
            "churn_reason",
            "churn_count",
            ratio(F.col("churn_count") * 100, F.col("total"), 1).alias("pct_of_plus_churn"),
        )
        .orderBy(F.desc_nulls_first("churn_count"), F.asc_nulls_last("churn_reason"))
        .limit(top_n)
    )


def _cohort_offsets(t: Tables, plan: str, offset) -> DataFrame:
    """(cohort_month, k, n): the plan's users of a signup month that churned k months on, by
    ``offset(churn_month, cohort_month)``; and with k NULL all its users.

    One pass over users: churn rows are reduced to a user's distinct months before the join (a
    user with very many churn rows collapses map-side), and each user then is one row per
    distinct offset and one for itself. ``users`` has one row per user.
    """
    churned = (
        t.facts("churn_events").where((F.col("plan") == plan) & F.col("user_id").isNotNull() & F.col("churn_date").isNotNull())
        .groupBy("user_id")
        .agg(F.collect_set(month_start(F.col("churn_date"))).alias("churn_months"))
    )
    users = t.users.where((F.col("plan_type") == plan) & F.col("user_id").isNotNull()).select(
        "user_id", month_start(F.col("signup_date")).alias("cohort_month")
    )
    months = F.coalesce("churn_months", F.array().cast("array<timestamp_ntz>"))
    offsets = F.transform(months, lambda m: offset(m, F.col("cohort_month")))
    own = F.array(F.lit(None).cast("bigint"))
    rows = users.join(churned, "user_id", "left").select(
        "cohort_month", F.explode(F.concat(own, F.array_distinct(F.filter(offsets, lambda k: k.isNotNull())))).alias("k")
    )
    return rows.groupBy("cohort_month", "k").agg(F.count(F.lit(1)).alias("n"))


def _curve(g: DataFrame) -> DataFrame:
    return g.select(
        "months_since_signup",
        "total_churned",
        "total_cohort",
        ratio(F.col("total_churned") * 100, F.col("total_cohort"), 2).alias(
            "churn_rate_at_month"
        ),
    ).orderBy("months_since_signup")


def churn_cohort_curve(
    t: Tables, plan: str = "plus", max_month: int = 12
) -> DataFrame:
    """Churn by months since signup, pooled over signup cohorts (2.3).

    Kept as specified: the offset is the *month component* of the age (0-11, so 13
    months counts as 1 and 12 never occurs), and a cohort enters an offset's denominator
    only if it has a churner at that offset. ``churn_cohort_curve_true_months`` fixes both.
    """
    rows = _cohort_offsets(t, plan, month_component_of_age)
    of_cohort = Window.partitionBy("cohort_month")
    sized = rows.withColumn("size", F.max(F.when(F.col("k").isNull(), F.col("n"))).over(of_cohort))
    g = (
        sized.where(F.col("k").between(0, max_month))
        .groupBy(F.col("k").alias("months_since_signup"))
        .agg(F.sum("n").alias("total_churned"), F.sum("size").alias("total_cohort"))
    )
    return _curve(g)


def churn_cohort_curve_true_months(
    t: Tables,
    as_of: datetime | str | None = None,
    plan: str = "plus",
    max_month: int = 12,
) -> DataFrame:
    """Corrected 2.3: offsets are whole months since signup (no wrap), and the
    denominator of offset k is every cohort old enough to have reached it
    (``cohort_month + k months <= month(as_of)``), whether or not anyone churned.

    A cohort's own row is expanded to the offsets it has reached, at most ``max_month + 1``
    rows per signup month; churn counts of reached offsets are added to them: one pass, no join.
    """
    current = month_floor(parse_as_of(as_of))
    rows = _cohort_offsets(t, plan, months_between_starts).where(F.col("cohort_month").isNotNull())
    age = months_between_starts(ts_lit(current), F.col("cohort_month"))
    reached = F.least(age, F.lit(max_month).cast("bigint"))
    zero = F.lit(0).cast("bigint")

    def entry(k, churned, size):
        return F.struct(k.alias("months_since_signup"), churned.alias("churned"), size.alias("size"))

    own = F.transform(F.sequence(zero, reached), lambda k: entry(k, zero, F.col("n")))
    hit = F.array(entry(F.col("k"), F.col("n"), zero))
    entries = F.when(F.col("k").isNull() & (age >= 0), own).when(F.col("k").between(0, reached), hit)
    g = rows.select(F.explode(entries).alias("e")).select("e.*").groupBy("months_since_signup").agg(
        F.sum("churned").alias("total_churned"), F.sum("size").alias("total_cohort")
    )
    return _curve(g)


def revenue_leakage(
    t: Tables,
    plan: str = "plus",
    status: str = "active",
    monthly_churn_rate: float | str = "0.042",
    improvement: float | str = "0.01",
    target_rate: float | str = "0.025",
) -> DataFrame:
    """Annual revenue lost to churn at a fixed monthly rate, and two what-if savings (2.4).

    One global aggregate (distinct users, MRR sum and row count), then scalar arithmetic.
    Every product is one exact integer ratio rounded once, as each is rounded from
    unrounded inputs in the specification.
    """
    s = t.facts("subscriptions").where((F.col("plan") == plan) & (F.col("status") == status))
    m = s.agg(
        F.count_distinct("user_id").alias("n"),
        F.sum("mrr_cents").alias("mrr_cents"),
        F.sum("mrr_rows").alias("mrr_rows"),
    )
    rate = as_fraction(monthly_churn_rate)
    step = as_fraction(improvement)
    gap = rate - as_fraction(target_rate)
    n, c, k = F.col("n"), F.col("mrr_cents"), F.col("mrr_rows")

    def leak(fr):  # ROUND(n * fr * 12 * (12 * avg_mrr))
        return ratio_scaled(big(n) * (fr.numerator * 144) * big(c), k * (fr.denominator * 100), 0)

    pct = rate * 100
    return m.select(
        n.alias("total_plus_users"),
        ratio(c * 12, k * 100, 0).alias("arpu_per_year"),
        (F.lit(pct.numerator).cast("double") / F.lit(float(pct.denominator))).alias(
            "monthly_churn_pct"
        ),
        ratio(n * rate.numerator, rate.denominator, 0).alias("monthly_churned_users"),
        ratio(big(n) * (rate.numerator * 12), rate.denominator, 0).alias("annual_churned_users"),
        dollars(leak(rate)).alias("annual_revenue_leakage_usd"),
        dollars(leak(step)).alias("saved_if_churn_minus_1pp"),
        dollars(leak(gap)).alias("saved_if_churn_at_target"),
    )
