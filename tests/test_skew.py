"""A hot user holding about a third of every table: results stay exact, and with
broadcasts off AQE splits the skewed join partitions instead of giving one task the
whole user."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import handmade
from ledgerlens import operators as ops
from ledgerlens import oracle
from ledgerlens.plans.inspect import explain
from ledgerlens.plans.registry import REGISTRY
from ledgerlens.sources import SCHEMAS, Tables
from oracle_harness import compare

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    rows = handmade.hot_user_rows()
    yield handmade.spark_tables(spark, rows=rows), handmade.duck_tables(rows=rows)
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_hot_user_results_exact(name, skewed):
    t, con = skewed
    a = REGISTRY[name]
    df = a.run(t)
    with oracle.business_tables_given():
        problems = compare(df, con, a.sql(**a.params))
    assert not problems, "\n".join(problems)


def test_upgrade_rate_reduces_the_hot_user_before_the_join(spark, skewed):
    """The hot user's higher-plan rows become distinct starts; no copy of the cohort is made."""
    t, _ = skewed
    plan = explain(REGISTRY["upgrade_rate"].run(t))
    assert "Generate" not in plan and plan.count("salt") == 0
    rows = [(i, 1, ["plus", "business"][i % 2], "active", datetime(2025, 1, 1 + i % 28), None, None) for i in range(9000)]
    subs = spark.createDataFrame(rows, SCHEMAS["subscriptions"]).repartition(8)
    higher = subs.where(F.col("plan") == "business").select("user_id", "start_date").distinct()
    assert higher.count() <= 28
    many = Tables.from_frames(subscriptions=subs, **{n: getattr(t, n) for n in SCHEMAS if n != "subscriptions"})
    assert tuple(ops.upgrade_rate(many).first()[:2]) == (1, 1)


@pytest.mark.parametrize("window_days", [0, 1, 7])
def test_one_day_burst_of_one_user(spark, skewed, window_days):
    """A third of all events on one day by one user: one reduced row per type and feature meets
    the join, and the result is the oracle's."""
    base = handmade.hot_user_rows()
    up = datetime(2024, 3, 5, 12)
    base["subscriptions"] = [r for r in base["subscriptions"] if r[1] != 1] + [(1, 1, "business", "active", up, None, None)]
    burst = [
        (900_000 + i, 1, ["ai_paywall_shown", "page_limit_hit"][i % 2], ["docs", "databases"][i // 2 % 2], up - timedelta(seconds=i - 300), "mobile")
        for i in range(6000)
    ]
    base["events"] = [e for e in base["events"] if e[1] != 1] + burst
    t = handmade.spark_tables(spark, rows=base)
    ev = t.events.where(F.col("user_id") == 1)
    assert ev.count() == 6000
    df = ops.upgrade_triggers(t, window_days=window_days)
    with oracle.business_tables_given():
        problems = compare(df, handmade.duck_tables(rows=base), oracle.upgrade_triggers(window_days=window_days))
    assert not problems, "\n".join(problems)
    if window_days:
        days = ev.select(F.to_date("created_at")).distinct().count()
        reduced = ev.groupBy("user_id", F.to_date("created_at"), "event_type", "feature_name").count().count()
        assert reduced <= 4 * days
        partial = explain(df).split("Exchange")[0]
        assert "partial_min(created_at" in explain(df) and "partial_max(created_at" in explain(df), partial
