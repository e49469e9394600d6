"""Windows of the upgrade triggers, the run-time filter and ranks without a whole-table window."""

from __future__ import annotations

import random
from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import handmade
from ledgerlens import operators as ops
from ledgerlens import oracle
from ledgerlens.functions import id_filter, rank_descending
from ledgerlens.plans.inspect import explain
from ledgerlens.sources import SCHEMAS, Tables
from oracle_harness import compare

TYPES = ("ai_paywall_shown", "feature_limit_hit", "page_view", "upgrade_cta_clicked")


def timed_rows(seed):
    """Upgrades and events at colliding instants around window limits, also before 1970."""
    r = random.Random(seed)
    starts = [dt(2025, 3, 1), dt(2025, 3, 1, 12), dt(1969, 12, 31, 23, 59, 59), dt(1970, 1, 1), dt(2024, 2, 29, 0, 0, 1)]
    steps = [timedelta(0), timedelta(microseconds=1), timedelta(hours=12), timedelta(days=1), timedelta(days=7), timedelta(days=90), timedelta(days=400), timedelta(days=3)]
    subs = [(i, r.choice([None, *range(9)]), r.choice(("plus", "business", "enterprise")), "active", r.choice([None, *starts]), None, None) for i in range(25)]
    events = []
    for i in range(500):
        at = r.choice(starts) - r.choice(steps) + r.choice([timedelta(0), timedelta(microseconds=1), -timedelta(microseconds=1), timedelta(hours=5)])
        events.append((i, r.choice([None, *range(12)]), r.choice(TYPES), r.choice((None, "docs", "mail")), at, None))
    return {name: [] for name in SCHEMAS} | {"subscriptions": subs, "events": events}


@pytest.mark.parametrize("days", [0, 1, 7, 90, 400])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_window_against_the_oracle(spark, days, seed):
    rows = timed_rows(seed)
    t, con = handmade.spark_tables(spark, rows=rows), handmade.duck_tables(rows=rows)
    with oracle.business_tables_given():
        sql = oracle.upgrade_triggers(window_days=days, top_n=50)
    for prefilter in (True, False):
        assert not compare(ops.upgrade_triggers(t, window_days=days, top_n=50, prefilter=prefilter), con, sql)


def test_two_rows_a_user_for_any_window(spark):
    t = handmade.spark_tables(spark)
    for days in (1, 7, 400):
        plan = explain(ops.upgrade_triggers(t, window_days=days), "extended")
        assert "sequence(" not in plan.split("== Physical Plan ==")[1].split("Subquery")[0]
    with pytest.raises(ValueError, match="negative"):
        ops.upgrade_triggers(t, window_days=-1)


def test_filter_stands_before_the_aggregate(spark):
    """Of many users' events, those of the few upgraders reach the reduction."""
    n = 20_000
    subs = [(i, 7 * i, "business", "active", dt(2025, 3, 1), None, None) for i in range(50)]
    events = [(i, i % 5000, TYPES[0], "docs", dt(2025, 2, 26) + timedelta(seconds=i), None) for i in range(n)]
    frames = {name: spark.createDataFrame([], s) for name, s in SCHEMAS.items()}
    frames |= {"subscriptions": spark.createDataFrame(subs, SCHEMAS["subscriptions"]), "events": spark.createDataFrame(events, SCHEMAS["events"])}
    t = Tables.from_frames(**frames)
    with_filter, without = (ops.upgrade_triggers(t, prefilter=p) for p in (True, False))
    assert with_filter.collect() == without.collect()
    assert "Subquery" in explain(with_filter)
    ids = t.subscriptions.where("plan = 'business'")
    passed = t.events.where(id_filter(ids, "user_id", F.col("user_id"))).select("user_id").collect()
    upgraders = {7 * i for i in range(50)}
    kept = {r.user_id for r in passed}
    assert upgraders <= kept | {u for u in upgraders if u >= 5000}
    assert len(passed) < n / 50  # 1 % of the rows belong to upgraders; hardly any other passes


def test_filter_of_no_ids(spark):
    ids = spark.createDataFrame([], "user_id bigint")
    df = spark.range(100).withColumnRenamed("id", "u")
    assert df.where(id_filter(ids, "user_id", F.col("u"))).count() == 0


def ranks(values):
    return sorted(((v, 1 + sum((w is None and v is not None) or (w is not None and v is not None and w > v) for w in values)) for v in values), key=repr)


@pytest.mark.parametrize("values", [
    [],
    [None, None],
    [5, 5, 5],
    [None, 3, 3, 1, 0, -1, -1, 70_000, 65_536, 65_535, -65_536, -65_537],
    [2**62, -(2**62), 2**63 - 1, -(2**63), 0, 0, None],
    [random.Random(5).randrange(-200_000, 200_000) for _ in range(500)],
])
def test_rank_against_its_definition(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = rank_descending(df, "v", "r").collect()
    assert sorted(((x.v, x.r) for x in got), key=repr) == ranks(values)


def test_rank_of_a_million_features(spark):
    """A million names, most of one rate: every rank by hand, and no window that sees all rows."""
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).cast("bigint").alias("rate"))
    ranked = rank_descending(df, "rate", "r")
    plan = explain(ranked, "simple")
    assert "Window" in plan and "Exchange SinglePartition" not in plan.split("Subquery")[0].split("Window")[1].split("HashAggregate")[0]
    got = ranked.agg(F.count("*"), F.sum("r"), F.max("r"), F.sum(F.when(F.col("r") == F.lit((n - 1) // 3 + 1), 1).otherwise(0))).first()
    higher = (n - 1) // 3  # rates 3, 6, ...; all others are 0
    zeros = n - higher
    assert got[0] == n and got[2] == higher + 1 and got[3] == zeros
    assert got[1] == higher * (higher + 1) // 2 + zeros * (higher + 1)
