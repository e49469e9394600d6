"""The fact tables as weighted rows, and the grouping that shrinks them to states.

An analysis reads a fact through ``Tables.facts``: rows with the keys it may group or filter by, and
sums, first and last times that stand for one or many base rows. Over base tables every row has the
weight 1; over stored states (``states.py``) a row stands for all base rows of one group. Sums, minima
and maxima merge, so an analysis gives the same result on either. Every grouping holds the
user, so counts of distinct users stay exact, and is made within one month of the time column, so
states of different months never have to be merged to be stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import cents
from ..functions.timeutil import month_start


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _present(c: str) -> Column:
    return F.col(c).isNotNull().cast("bigint")


@dataclass(frozen=True)
class Fact:
    time: str  # time column of the base table
    columns: Callable[[], dict[str, Column]]  # weighted row of one base row
    keys: dict[str, Callable[[], Column]]  # state column -> expression over a weighted row
    sums: tuple[str, ...]
    least: tuple[str, ...] = ()
    most: tuple[str, ...] = ()

    def view(self, base: DataFrame) -> DataFrame:
        return base.select(*[c.alias(k) for k, c in self.columns().items()])

    def state(self, rows: DataFrame, *within: str) -> DataFrame:
        """Weighted rows (or states) as one row per group, also within the columns ``within``."""
        keys = [make().alias(k) for k, make in self.keys.items()]
        out = [F.sum(c).alias(c) for c in self.sums]
        out += [F.min(c).alias(c) for c in self.least] + [F.max(c).alias(c) for c in self.most]
        return rows.groupBy(*within, *keys).agg(*out)


def _same(*names: str) -> dict[str, Callable[[], Column]]:
    return {n: (lambda n=n: F.col(n)) for n in names}


FACTS: dict[str, Fact] = {
    "subscriptions": Fact(
        "start_date",
        lambda: {
            **{c: F.col(c) for c in ("user_id", "plan", "status", "start_date", "end_date")},
            "mrr_cents": cents(F.col("mrr")),
            "mrr_rows": _present("mrr"),
            "rows": _one(),
        },
        _same("user_id", "plan", "status", "start_date", "end_date"),
        ("mrr_cents", "mrr_rows", "rows"),
    ),
    # within one day, the first and the last event of a group decide every window of whole days
    "events": Fact(
        "created_at",
        lambda: {
            **{c: F.col(c) for c in ("user_id", "event_type", "feature_name", "platform")},
            "first_at": F.col("created_at"),
            "last_at": F.col("created_at"),
            "rows": _one(),
        },
        {**_same("user_id", "event_type", "feature_name", "platform"), "day": lambda: F.to_date("first_at")},
        ("rows",),
        ("first_at",),
        ("last_at",),
    ),
    "feature_usage": Fact(
        "month",
        lambda: {
            **{c: F.col(c) for c in ("user_id", "feature_name", "month", "is_active_user")},
            "usage_sum": F.col("usage_count"),
            "usage_rows": _present("usage_count"),
            "rows": _one(),
        },
        _same("user_id", "feature_name", "month", "is_active_user"),
        ("usage_sum", "usage_rows", "rows"),
    ),
    # paid_at of a state is the month; analyses bound payments by whole months only
    "payments": Fact(
        "payment_date",
        lambda: {
            "user_id": F.col("user_id"),
            "status": F.col("status"),
            "paid_at": F.col("payment_date"),
            "rev_cents": cents(F.col("amount")),
            "pay_rows": _present("amount"),
            "rows": _one(),
        },
        {**_same("user_id", "status"), "paid_at": lambda: month_start(F.col("paid_at"))},
        ("rev_cents", "pay_rows", "rows"),
    ),
    "churn_events": Fact(
        "churn_date",
        lambda: {**{c: F.col(c) for c in ("user_id", "plan", "churn_date", "churn_reason")}, "rows": _one()},
        _same("user_id", "plan", "churn_date", "churn_reason"),
        ("rows",),
    ),
}
# The last event time of a state row decides whether any of its events is at or after a bound.
BOUND_BY = {
    "subscriptions": "start_date",
    "events": "last_at",
    "feature_usage": "month",
    "payments": "paid_at",
    "churn_events": "churn_date",
}


@dataclass(frozen=True)
class Users:
    """Exact sets of users as bitmaps: which users of a fact, per group and month.

    ``keys`` are the groups. A bitmap covers one
    bucket of ids (``bitmap_bucket_number``, 32,768 ids, 4 KB); sets of different months or groups are
    united by ``bitmap_or_agg``, exactly and whatever their number of rows. A group whose rows
    have no user keeps an empty set (with a null bucket).
    """

    fact: str
    keys: dict[str, Callable[[], Column]]

    def bitmaps(self, rows: DataFrame, *within: str) -> DataFrame:
        keys = [make().alias(k) for k, make in self.keys.items()]
        bucket = F.bitmap_bucket_number("user_id").alias("bucket")
        return rows.groupBy(*within, *keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users"))


USER_SETS: dict[str, Users] = {
    "starts": Users("subscriptions", {**_same("plan", "status"), "month": lambda: month_start(F.col("start_date"))}),
    "churners": Users("churn_events", {**_same("plan"), "month": lambda: month_start(F.col("churn_date"))}),
    "usage_users": Users("feature_usage", {**_same("feature_name", "month"), "active": lambda: F.coalesce("is_active_user", F.lit(False))}),
    "event_users": Users("events", {**_same("platform"), "day": lambda: F.to_date("last_at")}),
}
# Time column of a set, for bounds that are whole groups of it.
SET_TIME = {"starts": "month", "churners": "month", "usage_users": "month", "event_users": "day"}
