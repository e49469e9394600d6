"""Schemas of the seven business tables every analysis reads."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DecimalType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(12, 2)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


USERS = _s(
    ("user_id", LongType()),
    ("signup_date", TimestampNTZType()),
    ("country", StringType()),
    ("plan_type", StringType()),
    ("is_active", BooleanType()),
)

SUBSCRIPTIONS = _s(
    ("sub_id", LongType()),
    ("user_id", LongType()),
    ("plan", StringType()),
    ("status", StringType()),
    ("start_date", TimestampNTZType()),
    ("end_date", TimestampNTZType()),
    ("mrr", MONEY),
)

EVENTS = _s(
    ("event_id", LongType()),
    ("user_id", LongType()),
    ("event_type", StringType()),
    ("feature_name", StringType()),
    ("created_at", TimestampNTZType()),
    ("platform", StringType()),
)

FEATURE_USAGE = _s(
    ("user_id", LongType()),
    ("feature_name", StringType()),
    ("month", TimestampNTZType()),
    ("usage_count", LongType()),
    ("is_active_user", BooleanType()),
)

PAYMENTS = _s(
    ("payment_id", LongType()),
    ("user_id", LongType()),
    ("amount", MONEY),
    ("currency", StringType()),
    ("payment_date", TimestampNTZType()),
    ("status", StringType()),
)

CHURN_EVENTS = _s(
    ("churn_id", LongType()),
    ("user_id", LongType()),
    ("plan", StringType()),
    ("churn_date", TimestampNTZType()),
    ("churn_reason", StringType()),
)

GEO_DATA = _s(
    ("user_id", LongType()),
    ("country", StringType()),
    ("region", StringType()),
    ("city", StringType()),
)

SCHEMAS: dict[str, StructType] = {
    "users": USERS,
    "subscriptions": SUBSCRIPTIONS,
    "events": EVENTS,
    "feature_usage": FEATURE_USAGE,
    "payments": PAYMENTS,
    "churn_events": CHURN_EVENTS,
    "geo_data": GEO_DATA,
}


def check_schema(name: str, actual: StructType) -> None:
    """Raise if a table lacks a column of the expected name and type."""
    want = SCHEMAS[name]
    have = {f.name: f.dataType for f in actual.fields}
    problems = [
        f"{f.name}: expected {f.dataType.simpleString()}, got "
        f"{have[f.name].simpleString() if f.name in have else 'missing'}"
        for f in want.fields
        if have.get(f.name) != f.dataType
    ]
    if problems:
        raise ValueError(f"table {name!r} does not match its schema: " + "; ".join(problems))
