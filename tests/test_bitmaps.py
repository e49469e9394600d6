"""Exact bitmaps: merged over months, met with other sets, and what they save in shuffles."""

from __future__ import annotations

import random
from datetime import datetime as dt

import pytest

import handmade
from ledgerlens import operators as ops
from ledgerlens.plans.registry import BITMAP, REGISTRY
from ledgerlens.operators.bitmaps import count_common, count_users
from ledgerlens.sources import SCHEMAS, Tables
from ledgerlens import oracle
from oracle_harness import compare


@pytest.mark.parametrize("days", [0, 1, 29, 30, 45, 400])
@pytest.mark.parametrize("as_of", ["2025-08-01", "2025-08-01 13:30:00", "2025-07-30 23:59:59.999999"])
def test_windows_that_begin_within_a_day(spark, days, as_of):
    t = handmade.spark_tables(spark)
    a = REGISTRY["platform_mix_by_region"]
    with oracle.business_tables_given():
        sql = a.sql(as_of=dt.fromisoformat(as_of), lookback_days=days)
    assert not compare(ops.platform_mix_by_region_bitmap(t, as_of, days), handmade.duck_tables(), sql)


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_on_both_sides_of_buckets(spark, seed):
    """Ids around bucket limits, negative and very large ones."""
    r = random.Random(seed)
    ids = [k * 32768 + d for k in (-2, -1, 0, 1, 2, 5) for d in (-1, 0, 1, 2)] + [2**62, -(2**62), 2**63 - 1]
    rows = [(r.choice(ids), r.choice("ab"), r.randrange(5)) for _ in range(300)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "user_id bigint, k string, m int")
    sets = df.groupBy("k", "m", F.bitmap_bucket_number("user_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users")
    )
    got = {x.k: x.n for x in count_users(sets, "k").collect()}
    want = {k: {u for u, kk, _ in rows if kk == k} for k in "ab"}
    assert got == {k: len(v) for k, v in want.items()}
    common = count_common(sets.where("k = 'a'"), (), sets.where("k = 'b'")).collect()
    assert [x.n for x in common] == [len(want["a"] & want["b"])]


def test_bitmaps_shuffle_less(spark):
    """Many users in few groups: bytes that the exchanges write, by the plans' own metrics
    (the frames are not repartitioned: those exchanges would count on both sides)."""
    n = 60_000
    subs = [(i, i, ("plus", "business")[i % 2], "active", dt(2025, 6, 1 + i % 28), None, None) for i in range(n)]
    churn = [(i, i, "plus", dt(2025, 7, 1 + i % 28), "x") for i in range(0, n, 3)]
    frames = {name: spark.createDataFrame([], s) for name, s in SCHEMAS.items()}
    frames |= {"subscriptions": spark.createDataFrame(subs, SCHEMAS["subscriptions"]), "churn_events": spark.createDataFrame(churn, SCHEMAS["churn_events"])}
    t = Tables.from_frames(**frames)
    direct, bitmap = ops.monthly_churn_rate(t, "2025-08-01"), ops.monthly_churn_rate_bitmap(t, "2025-08-01")
    assert direct.collect() == bitmap.collect()
    before, after = (shuffled(df) for df in (direct, bitmap))
    print(f"shuffle bytes written: {before} by users, {after} by bitmaps")
    assert after < before / 4


def shuffled(df):
    """Shuffle bytes written by one run, by the executed plan's metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name == "ReusedExchangeExec":
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleBytesWritten").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_registered_forms():
    assert BITMAP <= set(REGISTRY)
