"""Counts of faulty keys and values come with the queries, without jobs of their own."""

from __future__ import annotations

import tempfile
from datetime import datetime as dt
from decimal import Decimal as D

import handmade
from ledgerlens import operators as ops
from ledgerlens import oracle
from ledgerlens.plans.registry import REGISTRY
from ledgerlens.sources import Quality, read_parquet_tables, read_states, refresh_states
from oracle_harness import compare


def dirty_rows():
    rows = {k: list(v) for k, v in handmade.ROWS.items()}
    rows["users"] += [(30, dt(2025, 1, 1), "X", "gold", True), (31, None, "X", "plus", True), (None, None, "X", None, True), (None, None, "Y", None, True)]
    rows["subscriptions"] += [(90, 77, "plus", "unheard", dt(2025, 1, 1), None, D("1.00")), (91, 78, "silver", "active", None, None, None)]
    rows["payments"] += [(3000, 77, D("5.00"), "USD", dt(2025, 1, 1), "completed"), (3001, 77, D("5.00"), "USD", dt(2025, 1, 9), "completed"), (3002, None, None, "USD", None, "odd")]
    return rows


def jobs(spark, run):
    """Number of Spark jobs that ``run`` starts."""
    tracker = spark.sparkContext.statusTracker()
    group = f"quality-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_counts(spark):
    t = handmade.spark_tables(spark, rows=dirty_rows())
    q = Quality()
    watched = q.watch(t)
    assert ops.region_revenue_arpu(watched).collect() == ops.region_revenue_arpu(t).collect()
    got = {(a, b): n for a, b, n in q.report()}
    assert got["users", "rows"] == len(handmade.USERS) + 4
    assert got["users", "null_user_id"] == 2 and got["users", "null_signup_date"] == 4
    assert got["users", "unknown_plan_type"] == 1 and got["users", "repeated_key_rows"] == 0
    assert got["geo_data", "repeated_key_rows"] == 2
    assert got["payments", "null_user_id"] == 1 and got["payments", "null_amount"] == 2
    assert got["payments", "null_payment_date"] == 1 and got["payments", "unknown_status"] == 1
    assert ("geo_data", "repeated_key_rows", 2) in q.problems()
    assert all(m != "rows" for _, m, _ in q.problems())


def test_bounded_reads_count_what_they_read(spark):
    q = Quality()
    ops.annual_revenue_growth(q.watch(handmade.spark_tables(spark))).collect()
    assert dict((b, n) for a, b, n in q.report() if a == "payments")["rows"] == 7  # one is of 2026


def test_no_job_is_added(spark):
    root = tempfile.mkdtemp(prefix="ledgerlens-quality-")
    t = handmade.spark_tables(spark, rows=dirty_rows())
    for name in handmade.ROWS:
        getattr(t, name).write.parquet(f"{root}/{name}")
    t = read_parquet_tables(spark, root, duplicates="ignore")
    for name in ("region_revenue_arpu", "mrr_by_plan", "churn_cohort_curve", "feature_stickiness"):
        REGISTRY[name].run(t).collect()  # code is compiled and files are listed
        # frames of their own: one that has run keeps its stages
        plain, counting = (REGISTRY[name].run(x) for x in (t, Quality().watch(t)))
        assert jobs(spark, counting.collect) <= jobs(spark, plain.collect) + 1, name  # the key window is a stage of its own


def test_every_analysis_keeps_its_result(spark):
    rows = handmade.ROWS
    t, con = handmade.spark_tables(spark, rows=rows), handmade.duck_tables(rows=rows)
    for name, a in REGISTRY.items():
        q = Quality()
        with oracle.business_tables_given():
            assert not compare(a.run(q.watch(t)), con, a.sql(**a.params)), name
        assert q.report(), name


def test_orphans_are_counted_by_the_refresh(spark):
    root, out = (tempfile.mkdtemp(prefix="ledgerlens-quality-") for _ in range(2))
    rows = dirty_rows()
    t = handmade.spark_tables(spark, rows=rows)
    for name in handmade.ROWS:
        getattr(t, name).write.parquet(f"{root}/{name}")
    t = read_parquet_tables(spark, root, duplicates="ignore")
    q = Quality()
    refresh_states(spark, t, out, quality=q)
    got = {(a, b): n for a, b, n in q.report()}
    users = {r[0] for r in rows["users"]}
    for name, at in (("payments", 1), ("subscriptions", 1), ("events", 1), ("churn_events", 1), ("feature_usage", 0)):
        assert got[name, "orphan_rows"] == sum(r[at] is not None and r[at] not in users for r in rows[name]), name
        assert got[name, "rows"] == len(rows[name])
    assert got["payments", "orphan_rows"] == 2 and got["subscriptions", "unknown_plan"] == 1
    a = REGISTRY["top_countries"]
    with oracle.business_tables_given():
        assert not compare(a.run(read_states(spark, out, t)), handmade.duck_tables(rows=rows), a.sql(**a.params))
