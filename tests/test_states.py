"""Stored states: same results as the facts, one read per month of a fact, refresh by month."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
from datetime import datetime as dt
from decimal import Decimal as D
from pathlib import Path

import pytest

import handmade
from ledgerlens import oracle
from ledgerlens.plans.registry import REGISTRY
from ledgerlens.sources import (
    SCHEMAS,
    Tables,
    read_business_tables,
    read_parquet_tables,
    read_states,
    refresh_states,
    states,
    write_business_tables,
)
from ledgerlens.sources.facts import FACTS
from ledgerlens.sources.store import Store
from oracle_harness import compare

ROOT = Path(__file__).resolve().parents[1]


def folder(name):
    return tempfile.mkdtemp(prefix=f"ledgerlens-{name}-")


def base(spark, database, rows=None):
    write_business_tables(spark, handmade.spark_tables(spark, rows=rows), database, folder("base"), buckets=4)
    return read_business_tables(spark, database, duplicates="ignore")


def assert_matches(t, con, names=None):
    for name in names or REGISTRY:
        a = REGISTRY[name]
        with oracle.business_tables_given():
            problems = compare(a.run(t), con, a.sql(**a.params))
        assert not problems, (name, problems)


@pytest.fixture(scope="module")
def by_month(spark):
    t = base(spark, "ll_states")
    root = folder("states")
    read = refresh_states(spark, t, root)
    assert all(read[name] for name in FACTS)
    return t, root


@pytest.mark.parametrize("name", list(REGISTRY))
def test_every_analysis_from_states(spark, by_month, name):
    t = read_states(spark, by_month[1], by_month[0])
    assert set(t.states) >= set(FACTS)
    assert_matches(t, handmade.duck_tables(), [name])


@pytest.mark.parametrize("name", list(REGISTRY))
def test_analyses_read_states_only(spark, by_month, name):
    """No fact table is opened: of the base tables, the plans name users and geo_data at most."""
    from ledgerlens.plans.inspect import explain

    plan = explain(REGISTRY[name].run(read_states(spark, by_month[1], by_month[0])))
    assert not any(f"/{fact}]" in plan or f"ll_states.{fact}" in plan for fact in FACTS)


def test_hot_user(spark):
    rows = handmade.hot_user_rows(1500)
    t, root = base(spark, "ll_states_hot", rows), folder("states")
    refresh_states(spark, t, root)
    assert_matches(read_states(spark, root, t), handmade.duck_tables(rows=rows))


def test_bounds_skip_months(spark, by_month):
    t = read_states(spark, by_month[1], by_month[0])
    files = t.facts("payments", dt(2025, 1, 1), dt(2026, 1, 1)).inputFiles()
    assert {f.split("/_m=")[1][:7] for f in files} == {"2025-01", "2025-02", "2025-06", "2025-12"}
    assert t.facts("payments", dt(2030, 1, 1)).count() == 0


LATE = {
    "payments": [(2000, 3, D("70.00"), "USD", dt(2025, 8, 9), "completed"), (2001, 1, D("1.00"), "USD", dt(2019, 5, 20), "completed")],
    "events": [(50, 3, "ai_trial_expired", "docs", dt(2025, 7, 30, 12), "mobile"), (51, 2, "page_limit_hit", "docs", dt(2025, 8, 2), "desktop")],
    "subscriptions": [(60, 8, "business", "active", dt(2025, 8, 3), None, D("20.00"))],
    "churn_events": [(70, 3, "plus", dt(2025, 8, 4), "late")],
    "feature_usage": [(3, "docs", dt(2025, 8, 1), 9, True), (8, "docs", dt(2025, 7, 1), 2, True)],
}
TOUCHED = {
    "payments": ["2019-05-01", "2025-08-01"],
    "events": ["2025-07-01", "2025-08-01"],
    "subscriptions": ["2025-08-01"],
    "churn_events": ["2025-08-01"],
    "feature_usage": ["2025-07-01", "2025-08-01"],
}


def append(spark, database, name, rows):
    from pyspark.sql import functions as F

    from ledgerlens.functions import month_start
    from ledgerlens.sources.layout import MONTH_PARTITION, TIME_COLUMN

    df = spark.createDataFrame(rows, SCHEMAS[name])
    df = df.withColumn(MONTH_PARTITION, F.to_date(month_start(F.col(TIME_COLUMN[name]))))
    df.write.mode("append").format("parquet").partitionBy(MONTH_PARTITION).saveAsTable(f"{database}.{name}")


def test_refresh_reads_changed_months_only(spark):
    t, root = base(spark, "ll_states_late"), folder("states")
    refresh_states(spark, t, root)
    first = Store(spark, root).latest()
    assert refresh_states(spark, t, root) == {name: [] for name in FACTS}
    assert Store(spark, root).latest() == first
    for name, rows in LATE.items():
        append(spark, "ll_states_late", name, rows)
    t = read_business_tables(spark, "ll_states_late", duplicates="ignore")
    assert refresh_states(spark, t, root) == TOUCHED
    second = Store(spark, root).latest()
    for name in FACTS:  # months without change keep their files
        kept = {m: p for m, p in first["parts"][name].items() if f"{m}-01" not in TOUCHED[name]}
        assert kept.items() <= second["parts"][name].items()
    all_rows = {k: [*v, *LATE.get(k, [])] for k, v in handmade.ROWS.items()}
    assert_matches(read_states(spark, root, t), handmade.duck_tables(rows=all_rows))


def test_month_that_is_gone(spark):
    t, root = base(spark, "ll_states_gone"), folder("states")
    refresh_states(spark, t, root)
    spark.sql("ALTER TABLE ll_states_gone.payments DROP PARTITION (_month = '2025-12-01')")
    where = Path(t.folders["payments"].removeprefix("file:")) / "_month=2025-12-01"
    for f in where.glob("*"):  # an external table's files stay when the partition is dropped
        f.unlink()
    t = read_business_tables(spark, "ll_states_gone", duplicates="ignore")
    assert refresh_states(spark, t, root)["payments"] == []
    rows = handmade.ROWS | {"payments": [r for r in handmade.PAYMENTS if r[0] != 1004]}
    assert_matches(read_states(spark, root, t), handmade.duck_tables(rows=rows), ["annual_revenue_growth", "region_revenue_arpu"])


def test_killed_refresh_leaves_the_version_before(spark, monkeypatch):
    t, root = base(spark, "ll_states_killed"), folder("states")
    refresh_states(spark, t, root)
    for name, rows in LATE.items():
        append(spark, "ll_states_killed", name, rows)
    t = read_business_tables(spark, "ll_states_killed", duplicates="ignore")
    write = states._write

    def fails(rows, store, name):
        if name.endswith("/payments"):
            raise KeyboardInterrupt
        write(rows, store, name)

    monkeypatch.setattr(states, "_write", fails)
    with pytest.raises(KeyboardInterrupt):
        refresh_states(spark, t, root)
    monkeypatch.undo()
    before = read_states(spark, root, handmade.spark_tables(spark))
    assert_matches(before, handmade.duck_tables(), ["annual_revenue_growth", "monthly_churn_rate", "feature_adoption"])
    assert refresh_states(spark, t, root) == TOUCHED  # the next refresh does it all


def test_tables_without_month_folders(spark):
    root, out = folder("plain"), folder("states")
    frames = handmade.spark_tables(spark)
    for name in handmade.ROWS:
        getattr(frames, name).write.parquet(f"{root}/{name}")
    t = read_parquet_tables(spark, root, duplicates="ignore")
    assert set(refresh_states(spark, t, out)["events"]) == {""}
    assert_matches(read_states(spark, out, t), handmade.duck_tables())
    spark.createDataFrame(LATE["payments"], SCHEMAS["payments"]).write.mode("append").parquet(f"{root}/payments")
    t = read_parquet_tables(spark, root, duplicates="ignore")
    read = refresh_states(spark, t, out)
    assert read["payments"] == [""] and read["events"] == []
    rows = handmade.ROWS | {"payments": [*handmade.PAYMENTS, *LATE["payments"]]}
    assert_matches(read_states(spark, out, t), handmade.duck_tables(rows=rows), ["annual_revenue_growth", "top_countries", "health_dashboard"])


def test_empty_tables(spark):
    root, out = folder("empty"), folder("states")
    frames = handmade.spark_tables(spark, empty=True)
    for name in handmade.ROWS:
        getattr(frames, name).write.parquet(f"{root}/{name}")
    t = read_parquet_tables(spark, root)
    refresh_states(spark, t, out)
    assert_matches(read_states(spark, out, t), handmade.duck_tables(empty=True))


def test_tables_without_folders_are_refused(spark):
    with pytest.raises(ValueError, match="folder"):
        refresh_states(spark, handmade.spark_tables(spark), folder("none"))
    with pytest.raises(ValueError, match="no states"):
        read_states(spark, folder("none"), Tables({}))


_EVENT_LOG = """
import sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import SparkSession
import handmade, test_states as s
from ledgerlens.session import tuned_conf
b = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", {log!r}).config("spark.eventLog.rolling.enabled", "false")
b = b.config("spark.eventLog.compress", "false").config("spark.sql.warehouse.dir", {log!r} + "-wh")
for k, v in tuned_conf(4).items():
    b = b.config(k, v)
spark = b.getOrCreate()
mark = lambda x: spark.sparkContext.setJobGroup(x, x)
mark("write")
t = s.base(spark, "ll_states_log")
mark("first")
s.refresh_states(spark, t, {states!r})
mark("append")
for name, rows in s.LATE.items():
    s.append(spark, "ll_states_log", name, rows)
mark("open")
t = s.read_business_tables(spark, "ll_states_log", duplicates="ignore")
mark("second")
s.refresh_states(spark, t, {states!r}, sets=False)
spark.stop()
"""


def test_rows_read_by_event_log():
    """The first refresh reads each fact row once (and the states once more for the user sets); the
    second one reads the rows of the changed months only."""
    log, out = folder("log"), folder("states")
    code = _EVENT_LOG.format(root=str(ROOT), tests=str(ROOT / "tests"), log=log, states=out)
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
    stage_group, read = {}, {}
    for line in next(Path(log).iterdir()).read_text().splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            for s in e["Stage IDs"]:
                stage_group.setdefault(s, e["Properties"].get("spark.jobGroup.id"))
        if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            group = stage_group.get(e["Stage ID"])
            read[group] = read.get(group, 0) + e["Task Metrics"]["Input Metrics"]["Records Read"]
    months = {name: {f"{getattr(r[i], 'year', 0)}-{getattr(r[i], 'month', 0):02d}-01" for r in LATE[name]} for name, i in (("payments", 4), ("events", 4), ("subscriptions", 4), ("churn_events", 3), ("feature_usage", 2))}
    assert {k: sorted(v) for k, v in months.items()} == TOUCHED
    at = {"payments": 4, "events": 4, "subscriptions": 4, "churn_events": 3, "feature_usage": 2}
    all_rows = {name: [*handmade.ROWS[name], *LATE[name]] for name in FACTS}
    changed = sum(f"{r[at[n]]:%Y-%m}-01" in TOUCHED[n] for n in FACTS for r in all_rows[n])
    files = 2 * sum(1 for _ in Path(out).rglob("*.parquet"))  # listed files count as rows of the listing
    facts = sum(len(handmade.ROWS[n]) for n in FACTS)
    assert facts <= read["first"] <= 2 * facts + files
    assert changed <= read["second"] <= changed + files
    assert changed < facts / 2
