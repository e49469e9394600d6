"""Small hand-written business tables with the edge cases the test data lacks.

The same rows are loaded into Spark (as ``Tables``) and into DuckDB (as the business
tables the oracle SQL reads), so every analysis can be checked against its oracle on them.
"""

from __future__ import annotations

from datetime import datetime as dt
from datetime import timedelta
from decimal import Decimal as D

import duckdb
import pyarrow as pa

from ledgerlens.sources import SCHEMAS, Tables

USERS = [
    (1, dt(2025, 1, 15), "X", "plus", True),
    (2, dt(2024, 12, 1), "X", "plus", True),
    (3, dt(2024, 6, 30), "X", "business", True),
    (4, None, "X", "free", True),  # no signup date
    (5, dt(2025, 3, 31), "X", None, True),  # NULL plan
    (6, dt(2023, 1, 1), "X", "enterprise", False),
    (7, dt(2024, 7, 1), "X", "plus", None),  # NULL activity flag
    (8, dt(2024, 5, 1), "X", "plus", True),  # active, no payments
    (9, dt(2025, 5, 5), "Y", "free", True),
]

SUBSCRIPTIONS = [
    (10, 1, "plus", "active", dt(2025, 1, 15), None, D("10.00")),
    (11, 1, "business", "active", dt(2025, 3, 1), None, D("20.00")),
    (12, 2, "plus", "churned", dt(2024, 12, 1), dt(2025, 2, 10), D("10.00")),
    (13, 3, "business", "active", dt(2024, 6, 30), None, D("20.00")),
    (14, 3, "business", "active", dt(2025, 7, 5), None, None),  # 2nd active sub, NULL mrr
    (15, 6, "enterprise", "churned", dt(2023, 1, 1), dt(2024, 9, 1), D("50.00")),
    (16, 7, "plus", "paused", dt(2024, 7, 1), None, D("10.00")),
    (17, 8, "plus", "active", dt(2024, 5, 1), None, D("10.50")),
    (18, 2, "enterprise", "active", dt(2025, 7, 31, 23, 59, 59), None, D("45.00")),
    (19, None, "plus", "active", dt(2025, 5, 1), None, D("5.00")),  # NULL user
    (20, 9, "free", "active", dt(2025, 5, 5), None, D("0.00")),
    (21, 8, "plus", "churned", dt(2025, 7, 1), dt(2025, 7, 20), D("10.00")),
]

CHURN_EVENTS = [
    (100, 2, "plus", dt(2025, 2, 10), "price"),
    (101, 2, "plus", dt(2025, 2, 20), "price"),  # same user, same month
    (102, 1, "plus", dt(2026, 2, 1), "ai"),  # future; 13 months after signup month
    (103, 7, "plus", dt(2025, 7, 1), None),  # NULL reason; exactly 12 months
    (104, 8, "plus", dt(2023, 5, 1), "other"),  # 12 months *before* signup
    (105, 3, "business", dt(2025, 3, 15), "price"),
    (106, 6, "enterprise", dt(2024, 9, 1), "moved"),
    (107, 1, "plus", dt(2025, 12, 1), "ai"),  # 11 months
    (108, 8, "plus", dt(2025, 7, 20), "ai"),
]

PAYMENTS = [
    (1000, 1, D("12.34"), "USD", dt(2019, 5, 1), "completed"),
    (1001, 1, D("0.05"), "USD", dt(2021, 1, 1), "completed"),  # no 2020 at all
    (1002, 2, D("100.00"), "USD", dt(2025, 1, 1), "completed"),  # first instant of year
    (1003, 3, None, "USD", dt(2025, 6, 1), "completed"),  # NULL amount
    (1004, 3, D("50.00"), "USD", dt(2025, 12, 31, 23, 59, 59), "completed"),
    (1005, 5, D("999.99"), "USD", dt(2024, 3, 3), "refunded"),
    (1006, 2, D("33.33"), "USD", dt(2026, 1, 1), "completed"),  # outside the range
    (1007, 9, D("0.01"), "USD", dt(2025, 2, 2), "completed"),
]

GEO_DATA = [
    (1, "A", "North", "a"),
    (2, "B", "South", "b"),
    (3, "A", "North", "a"),
    (3, "A", "North", "a"),  # duplicate geography row
    (5, "C", "East", None),
    (7, "D", "West", "d"),
    (8, "E", "Nowhere", "e"),  # the only user there has no payment
    (4, None, None, None),
    (9, "Y", "North", "y"),
]

EVENTS = [
    (1, 1, "ai_paywall_shown", "ai_assistant", dt(2025, 2, 22), "mobile"),
    (2, 1, "page_view", "docs", dt(2025, 7, 10), "desktop"),
    (3, 2, "feature_limit_hit", "databases", dt(2025, 7, 24, 23, 59, 59), None),  # window start
    (4, 3, "upgrade_cta_clicked", "docs", dt(2024, 6, 30), "mobile"),  # at the upgrade instant
    (5, 7, "ai_paywall_shown", "ai_assistant", dt(2025, 7, 2), "mobile"),  # as_of - 30 days
    (6, None, "page_view", "docs", dt(2025, 7, 20), "desktop"),
    (7, 8, "page_view", "docs", dt(2024, 7, 30), "tablet"),  # signup + 90 days exactly
    (8, 5, "page_view", "docs", dt(2025, 7, 15), "desktop"),
    (9, 3, "upgrade_cta_clicked", "docs", dt(2024, 6, 22, 23, 59, 59), "desktop"),  # just outside
    (10, 9, "team_invite_blocked", None, dt(2025, 7, 31), "mobile"),
]

FEATURE_USAGE = [
    (1, "ai_assistant", dt(2025, 7, 1), 30, True),
    (1, "docs", dt(2025, 7, 1), 5, False),
    (3, "ai_assistant", dt(2025, 7, 1), 12, True),  # user with two active subscriptions
    (3, "ai_assistant", dt(2025, 6, 1), 7, True),
    (2, "docs", dt(2025, 7, 1), None, True),  # NULL usage
    (8, "docs", dt(2025, 2, 1), 3, True),
    (5, "ai_assistant", dt(2025, 7, 1), 1, None),
    (8, "ai_assistant", dt(2025, 3, 1), 4, True),
]

ROWS = {
    "users": USERS,
    "subscriptions": SUBSCRIPTIONS,
    "churn_events": CHURN_EVENTS,
    "payments": PAYMENTS,
    "geo_data": GEO_DATA,
    "events": EVENTS,
    "feature_usage": FEATURE_USAGE,
}

_ARROW_TYPES = {
    "bigint": pa.int64(),
    "string": pa.string(),
    "timestamp_ntz": pa.timestamp("us"),
    "boolean": pa.bool_(),
    "decimal(12,2)": pa.decimal128(12, 2),
}


def hot_user_rows(n: int = 6000) -> dict[str, list[tuple]]:
    """The edge-case rows plus one hot user (id 1) holding about a third of every table."""
    rows = {k: list(v) for k, v in ROWS.items()}
    base = dt(2024, 1, 1)
    types = ["ai_paywall_shown", "feature_limit_hit", "page_view", "upgrade_cta_clicked"]
    features = ["ai_assistant", "docs", "databases"]
    for i in range(n):
        t = base + timedelta(hours=7 * i)
        rows["events"].append(
            (10_000 + i, 1, types[i % 4], features[i % 3], t, ["mobile", "desktop", None][i % 3])
        )
        rows["payments"].append((20_000 + i, 1, D(f"{i % 997}.{i % 100:02d}"), "USD", t, "completed"))
        rows["subscriptions"].append(
            (30_000 + i, 1, ["business", "enterprise", "plus"][i % 3], "active", t, None, D("12.00"))
        )
        rows["churn_events"].append((40_000 + i, 1, "plus", t, f"r{i % 5}"))
        rows["feature_usage"].append(
            (1, features[i % 3], t.replace(day=1, hour=0), i % 50, i % 2 == 0)
        )
    # the other users: enough rows that the hot one is a third, not all
    for u in range(100, 100 + n // 3):
        t = base + timedelta(days=u % 500)
        rows["users"].append((u, t, "Z", ["plus", "free", "business"][u % 3], True))
        rows["geo_data"].append((u, f"C{u % 7}", f"R{u % 3}", None))
        for j in range(2):
            rows["events"].append((60_000 + 2 * u + j, u, types[u % 4], features[j], t, "mobile"))
            rows["payments"].append((70_000 + 2 * u + j, u, D("5.00"), "USD", t, "completed"))
        rows["subscriptions"].append((80_000 + u, u, ["plus", "business"][u % 2], "active", t, None, D("8.00")))
        rows["churn_events"].append((90_000 + u, u, "plus", t + timedelta(days=40), "price"))
        rows["feature_usage"].append((u, features[u % 3], t.replace(day=1), 30, True))
    return rows


def spark_tables(spark, empty: bool = False, rows: dict | None = None) -> Tables:
    rows = ROWS if rows is None else rows
    frames = {
        name: spark.createDataFrame([] if empty else data, SCHEMAS[name])
        for name, data in rows.items()
    }
    return Tables.from_frames(**frames)


def duck_tables(empty: bool = False, rows: dict | None = None) -> duckdb.DuckDBPyConnection:
    rows = ROWS if rows is None else rows
    con = duckdb.connect()
    for name, data in rows.items():
        schema = SCHEMAS[name]
        table = "activity" if name == "events" else name
        arrow_schema = pa.schema(
            [(f.name, _ARROW_TYPES[f.dataType.simpleString()]) for f in schema.fields]
        )
        data = [] if empty else data
        columns = list(zip(*data)) if data else [[] for _ in schema.fields]
        tbl = pa.Table.from_arrays(
            [pa.array(list(c), type=t.type) for c, t in zip(columns, arrow_schema)],
            schema=arrow_schema,
        )
        con.register(f"{table}_arrow", tbl)
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM {table}_arrow")
        con.unregister(f"{table}_arrow")
    return con
