"""Every analysis against its oracle on random small business tables: small domains so
that NULLs, duplicates, ties at cuts and window boundaries occur often."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

import handmade
from ledgerlens import oracle
from ledgerlens.plans.registry import REGISTRY
from oracle_harness import compare

AS_OF = datetime(2025, 8, 1)
# instants on and around the boundaries the analyses test
SPECIAL = [
    datetime(2025, 7, 1),
    datetime(2025, 2, 1),
    datetime(2024, 8, 1),
    datetime(2025, 7, 2),
    datetime(2025, 5, 3),
    datetime(2025, 1, 1),
    datetime(2024, 12, 31, 23, 59, 59),
]


def _ts(rng: random.Random, lo: datetime, hi: datetime, null: float = 0.1):
    if rng.random() < null:
        return None
    if rng.random() < 0.25:
        return rng.choice(SPECIAL)
    span = int((hi - lo).total_seconds())
    t = lo + timedelta(seconds=rng.randrange(span))
    return t.replace(microsecond=0) if rng.random() < 0.5 else t.replace(hour=0, minute=0, second=0, microsecond=0)


def _pick(rng, values, null=0.1):
    return None if rng.random() < null else rng.choice(values)


def random_rows(seed: int) -> dict[str, list[tuple]]:
    rng = random.Random(seed)
    plans = ["free", "plus", "business", "enterprise"]
    users = list(range(1, 31))
    uid = lambda: _pick(rng, users + [31, 32], 0.05)
    money = lambda: None if rng.random() < 0.1 else Decimal(rng.choice(["0.00", "0.05", "10.00", "12.34", "99.99", "250.50"]))  # noqa: E731,E501
    lo, hi = datetime(2023, 1, 1), datetime(2026, 3, 1)
    rows = {
        "users": [
            (u, _ts(rng, lo, AS_OF), "X", _pick(rng, plans), _pick(rng, [True, False]))
            for u in users
        ],
        "subscriptions": [
            (
                i,
                uid(),
                _pick(rng, plans),
                _pick(rng, ["active", "churned", "paused"]),
                _ts(rng, lo, hi),
                _ts(rng, lo, hi, 0.6),
                money(),
            )
            for i in range(70)
        ],
        "churn_events": [
            (i, uid(), _pick(rng, plans), _ts(rng, lo, hi), _pick(rng, list("abcdefghij")))
            for i in range(50)
        ],
        "payments": [
            (i, uid(), money(), "USD", _ts(rng, datetime(2018, 6, 1), hi), _pick(rng, ["completed", "refunded"]))
            for i in range(90)
        ],
        "geo_data": [
            (u, _pick(rng, ["A", "B", "C", "D", "E", "F"]), _pick(rng, ["North", "South", "East"]), None)
            for u in users
            for _ in range(rng.choice([0, 1, 1, 1, 2]))
        ],
        "events": [
            (
                i,
                uid(),
                _pick(rng, ["ai_paywall_shown", "feature_limit_hit", "page_limit_hit", "page_view"]),
                _pick(rng, ["ai_assistant", "docs", "databases"]),
                _ts(rng, datetime(2024, 6, 1), hi),
                _pick(rng, ["mobile", "desktop", "tablet"]),
            )
            for i in range(120)
        ],
        "feature_usage": [
            (
                uid(),
                _pick(rng, ["ai_assistant", "docs", "databases"]),
                datetime(2024, rng.randrange(9, 13), 1) if rng.random() < 0.4 else datetime(2025, rng.randrange(1, 9), 1),
                None if rng.random() < 0.1 else rng.randrange(0, 60),
                _pick(rng, [True, False]),
            )
            for _ in range(80)
        ],
    }
    return rows


@pytest.fixture(scope="module", params=[1, 2, 3])
def dataset(request, spark):
    rows = random_rows(request.param)
    return handmade.spark_tables(spark, rows=rows), handmade.duck_tables(rows=rows)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_random_tables_match_oracle(name, dataset):
    t, con = dataset
    a = REGISTRY[name]
    with oracle.business_tables_given():
        problems = compare(a.run(t), con, a.sql(**a.params))
    assert not problems, "\n".join(problems)
