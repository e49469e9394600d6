"""Business tables derived from the driver's TPC-H style test tables.

The test data (``customer orders lineitem events nation region``) does not contain the
seven business tables, so each one is a Spark plan over those tables, following the
mapping written down in FIXTURES.md. Nothing is materialised: an analysis that reads
``payments`` plans ``lineitem JOIN orders`` and Catalyst prunes it to the columns the
analysis uses; an analysis' time bounds are moved onto the raw time columns, so they reach the
Parquet scan. The oracle SQL (``ledgerlens.oracle``) inlines the same mapping.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import add_months, month_floor, month_start, plus_days, plus_months, ts_lit
from .tables import Tables

# Fixed values of the fixture mapping (FIXTURES.md section 3).
YEAR_SHIFT = 24  # orders/lineitem dates 1995-2001 move to 2019-2025
EVENT_MONTH_SHIFT = 18  # driver events Jan 2024 move to Jul 2025
FEATURES = [
    "ai_assistant",
    "databases",
    "integrations",
    "automations",
    "calendar",
    "docs",
    "mobile_app",
    "mail",
]
EVENT_TYPES = [
    "ai_paywall_shown",
    "feature_limit_hit",
    "upgrade_cta_clicked",
    "team_invite_blocked",
    "page_limit_hit",
    "ai_trial_expired",
    "page_view",
]
PLATFORMS = ["mobile", "desktop", None]
SIGNUP_SHIFT_DAYS = 2200  # applied when c_custkey % 4 = 0
CHURN_DELAY_MODULUS = 430
CHURN_REASON_MODULUS = 13
CHURN_REASON_CAP = 8
ORDER_EVENT_ID_BASE = 1_000_000_000
ORDER_EVENT_BACKDATE_MODULUS = 12
MRR_DIVISOR = 10_000
ACTIVE_USAGE_MIN = 25


def _pick(values: list[str | None], index: Column) -> Column:
    """``values[index]`` for a 0-based integer column."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (index + F.lit(1)).cast("int"))


def _plan_of_priority(priority: Column) -> Column:
    first = F.substring(priority, 1, 1)
    return (
        F.when(first == "1", "enterprise")
        .when(first == "2", "business")
        .when(first == "5", "free")
        .when(first.isin("3", "4"), "plus")
    )


def _plan_of_segment(segment: Column) -> Column:
    return (
        F.when(segment == "AUTOMOBILE", "enterprise")
        .when(segment == "BUILDING", "business")
        .when(segment == "HOUSEHOLD", "free")
        .otherwise("plus")
    )


def _shift_years(c: Column) -> Column:
    return plus_months(c, YEAR_SHIFT * 12)


# The raw test tables, restricted to the columns the mapping reads. An explicit schema
# skips footer-based schema inference (most of the cost of opening a small table).
RAW_SCHEMAS = {
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The seven business tables as lazy plans over ``{sf_dir}/*.parquet``."""
    opened: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.schema(RAW_SCHEMAS[name]).parquet(
                f"{sf_dir}/{name}.parquet"
            )
        return opened[name]

    def churn_date(orders: DataFrame) -> Column:
        return plus_days(
            _shift_years(orders["o_orderdate"]),
            (orders["o_orderkey"] % CHURN_DELAY_MODULUS).cast("int"),
        )

    def between(df: DataFrame, c: str, since, until, months: int, before: int = 0, after: int = 0):
        """Rows whose raw time ``c`` can give a time in [since, until] once it is moved by
        ``months`` and by between -``before`` and +``after`` days. One day is added on either
        side for the clamping of month ends; callers keep their exact predicate."""
        if since is not None:
            df = df.where(F.col(c) >= ts_lit(add_months(since, -months) - timedelta(days=after + 1)))
        if until is not None:
            df = df.where(F.col(c) <= ts_lit(add_months(until, -months) + timedelta(days=before + 1)))
        return df

    def subscriptions(since=None, until=None) -> DataFrame:
        o = between(raw("orders"), "o_orderdate", since, until, YEAR_SHIFT * 12)
        status = (
            F.when(o.o_orderstatus == "O", "active")
            .when(o.o_orderstatus == "F", "churned")
            .when(o.o_orderstatus == "P", "paused")
        )
        return o.select(
            o.o_orderkey.alias("sub_id"),
            o.o_custkey.alias("user_id"),
            _plan_of_priority(o.o_orderpriority).alias("plan"),
            status.alias("status"),
            _shift_years(o.o_orderdate).alias("start_date"),
            F.when(o.o_orderstatus == "F", churn_date(o)).alias("end_date"),
            F.floor(o.o_totalprice / MRR_DIVISOR).cast("decimal(12,2)").alias("mrr"),
        )

    def users() -> DataFrame:
        # One row per customer. The first order date and the nation name are correlated
        # scalar subqueries: Catalyst rewrites each into a left join with a per-key
        # aggregate when the column is used, and prunes it (no orders scan at all) when an
        # analysis never reads signup_date or country.
        c = raw("customer").alias("c")
        first_order = (
            raw("orders")
            .where(F.col("o_custkey") == F.col("c.c_custkey").outer())
            .select(F.min("o_orderdate"))
            .scalar()
        )
        nation_name = (
            raw("nation")
            .where(F.col("n_nationkey") == F.col("c.c_nationkey").outer())
            .select(F.max("n_name"))
            .scalar()
        )
        extra = F.when(F.col("c_custkey") % 4 == 0, SIGNUP_SHIFT_DAYS).otherwise(0)
        return c.select(
            F.col("c_custkey").alias("user_id"),
            plus_days(_shift_years(first_order), extra).alias("signup_date"),
            nation_name.alias("country"),
            _plan_of_segment(F.col("c_mktsegment")).alias("plan_type"),
            (F.col("c_acctbal") > 0).alias("is_active"),
        )

    def churn_events(since=None, until=None) -> DataFrame:
        o = raw("orders").where(F.col("o_orderstatus") == "F")
        o = between(o, "o_orderdate", since, until, YEAR_SHIFT * 12, after=CHURN_DELAY_MODULUS)
        reason = F.least(o.o_orderkey % CHURN_REASON_MODULUS, F.lit(CHURN_REASON_CAP))
        return o.select(
            o.o_orderkey.alias("churn_id"),
            o.o_custkey.alias("user_id"),
            _plan_of_priority(o.o_orderpriority).alias("plan"),
            churn_date(o).alias("churn_date"),
            F.concat(F.lit("reason_"), reason.cast("string")).alias("churn_reason"),
        )

    def order_lines(since, until) -> DataFrame:
        # the join takes the exchange (or broadcast) that the sizes call for
        o = raw("orders").select("o_orderkey", "o_custkey")
        li = between(raw("lineitem"), "l_shipdate", since, until, YEAR_SHIFT * 12)
        return li.join(o, li.l_orderkey == o.o_orderkey)

    def payments(since=None, until=None) -> DataFrame:
        j = order_lines(since, until)
        return j.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("payment_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
            F.lit("USD").alias("currency"),
            _shift_years(F.col("l_shipdate")).alias("payment_date"),
            F.when(F.col("l_returnflag") == "R", "refunded")
            .otherwise("completed")
            .alias("status"),
        )

    def feature_usage(since=None, until=None) -> DataFrame:
        # ``month`` is the group of all its days: whole months on either side
        first = None if since is None else month_floor(since)
        last = None if until is None else add_months(month_floor(until), 1)
        j = order_lines(first, last)
        shipped = _shift_years(F.col("l_shipdate"))
        g = j.groupBy(
            F.col("o_custkey").alias("user_id"),
            _pick(FEATURES, F.col("l_partkey") % len(FEATURES)).alias("feature_name"),
            month_start(shipped).alias("month"),
        ).agg(F.sum("l_quantity").alias("qty"))
        rows = g.select(
            "user_id",
            "feature_name",
            "month",
            F.col("qty").cast("bigint").alias("usage_count"),
            (F.col("qty") >= ACTIVE_USAGE_MIN).alias("is_active_user"),
        )
        # months that the bound cuts are no whole groups
        if first is not None:
            rows = rows.where(F.col("month") >= ts_lit(first))
        return rows if last is None else rows.where(F.col("month") < ts_lit(last))

    def events(since=None, until=None) -> DataFrame:
        e = between(raw("events"), "ts", since, until, EVENT_MONTH_SHIFT)
        k = F.get_json_object(e.props, "$.k").cast("bigint")
        from_events = e.select(
            e.event_id,
            e.user_id,
            _pick(EVENT_TYPES, k % len(EVENT_TYPES)).alias("event_type"),
            _pick(FEATURES, k % len(FEATURES)).alias("feature_name"),
            plus_months(e.ts, EVENT_MONTH_SHIFT).alias("created_at"),
            _pick(PLATFORMS, k % len(PLATFORMS)).alias("platform"),
        )
        o = between(
            raw("orders"), "o_orderdate", since, until, YEAR_SHIFT * 12, before=ORDER_EVENT_BACKDATE_MODULUS
        )
        key = o.o_orderkey
        from_orders = o.select(
            (F.lit(ORDER_EVENT_ID_BASE).cast("bigint") + key).alias("event_id"),
            o.o_custkey.alias("user_id"),
            _pick(EVENT_TYPES, key % len(EVENT_TYPES)).alias("event_type"),
            _pick(FEATURES, key % len(FEATURES)).alias("feature_name"),
            plus_days(
                _shift_years(o.o_orderdate),
                -(key % ORDER_EVENT_BACKDATE_MODULUS).cast("int"),
            ).alias("created_at"),
            _pick(PLATFORMS, key % len(PLATFORMS)).alias("platform"),
        )
        return from_events.unionByName(from_orders)

    def geo_data() -> DataFrame:
        c = raw("customer")
        n = raw("nation")
        r = raw("region")
        return (
            c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                c.c_custkey.alias("user_id"),
                n.n_name.alias("country"),
                r.r_name.alias("region"),
                F.lit(None).cast("string").alias("city"),
            )
        )

    bounded = {
        "subscriptions": subscriptions,
        "events": events,
        "feature_usage": feature_usage,
        "payments": payments,
        "churn_events": churn_events,
    }
    return Tables({"users": users, "geo_data": geo_data, **bounded}, bounded=bounded)
