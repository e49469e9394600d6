"""The stored layout: dimension tables bucketed by user, facts as plain Parquet."""

from __future__ import annotations

import tempfile

import pytest

import handmade
from ledgerlens import oracle
from ledgerlens.plans.inspect import explain
from ledgerlens.plans.registry import REGISTRY
from ledgerlens.sources import read_business_tables, write_business_tables
from oracle_harness import compare


@pytest.fixture(scope="module")
def stored(spark):
    root = tempfile.mkdtemp(prefix="ledgerlens-catalog-")
    write_business_tables(spark, handmade.spark_tables(spark), "ll_layout_test", root, buckets=8)
    return read_business_tables(spark, "ll_layout_test", duplicates="ignore")  # one geography row is double


@pytest.mark.parametrize("name", list(REGISTRY))
def test_results_unchanged(name, stored):
    a = REGISTRY[name]
    with oracle.business_tables_given():
        problems = compare(a.run(stored), handmade.duck_tables(), a.sql(**a.params))
    assert not problems


def test_dimension_join_needs_no_shuffle(spark, stored):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = explain(REGISTRY["region_revenue_arpu"].run(stored), "simple")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # only the (pre-aggregated) payments side is shuffled on user_id
    assert plan.count("Exchange hashpartitioning(user_id") == 1
    assert "Bucketed: true" in plan


def test_parquet_reader_validates_schema(spark):
    from pyspark.sql import functions as F

    from ledgerlens.sources import read_parquet_tables

    root = tempfile.mkdtemp(prefix="ledgerlens-drift-")
    t = handmade.spark_tables(spark)
    for name in handmade.ROWS:
        df = getattr(t, name)
        if name == "payments":  # a drifted file: amount written as a string
            df = df.withColumn("amount", F.col("amount").cast("string"))
        df.write.parquet(f"{root}/{name}")
    assert read_parquet_tables(spark, root).users.count() == len(handmade.USERS)
    with pytest.raises(ValueError, match="amount"):
        read_parquet_tables(spark, root).payments
    with pytest.raises(ValueError, match="geo_data.*1 values"):
        read_parquet_tables(spark, root).geo_data
    assert read_parquet_tables(spark, root, duplicates="ignore").geo_data.count() == len(handmade.GEO_DATA)


def test_missing_column_raises_by_default(spark):
    from ledgerlens import operators as ops
    from ledgerlens.sources import read_parquet_tables

    root = tempfile.mkdtemp(prefix="ledgerlens-missing-")
    handmade.spark_tables(spark).users.drop("is_active").write.parquet(f"{root}/users")
    with pytest.raises(ValueError, match="is_active"):
        ops.plan_user_distribution(read_parquet_tables(spark, root))


def test_every_duplicated_key_is_reported(spark):
    from ledgerlens.sources import Tables, check_unique_keys

    users = [(i, None, "X", "plus", True) for i in range(20)] + [(i, None, "Y", "plus", True) for i in range(6)]
    from ledgerlens.sources import SCHEMAS

    t = Tables.from_frames(
        users=spark.createDataFrame(users, SCHEMAS["users"]), geo_data=handmade.spark_tables(spark).geo_data
    )
    assert check_unique_keys(t)["users"].count() == 6


def test_files_are_in_time_order_and_few(spark):
    """Read the written files: (month, time) order in each, and a count that follows the
    partitions and months, not tasks times months."""
    import pyarrow.parquet as pq
    from pathlib import Path

    from ledgerlens.sources import fixture_tables
    from ledgerlens.sources.layout import TIME_COLUMN

    root = tempfile.mkdtemp(prefix="ledgerlens-files-")
    write_business_tables(spark, fixture_tables(spark, "/root/testdata/sf0.001"), "ll_layout_files", root, buckets=4)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, column in TIME_COLUMN.items():
        files = sorted(Path(root, name).rglob("*.parquet"))
        months = {f.parent.name for f in files}
        assert len(files) <= len(months) + partitions
        for f in files:
            times = [x for x in pq.read_table(f, columns=[column], partitioning=None)[column].to_pylist() if x is not None]
            assert times == sorted(times), f
    assert len(list(Path(root, "users").rglob("*.parquet"))) <= 4


def test_files_added_between_two_queries_count(spark):
    import shutil
    from pathlib import Path

    src = Path("/root/testdata/sf0.001")
    root = Path(tempfile.mkdtemp(prefix="ledgerlens-grow-"))
    for p in src.glob("*.parquet"):
        (root / p.name).mkdir()
        shutil.copy(p, root / p.name / "part-0.parquet")
    a = REGISTRY["plan_user_distribution"]
    total = lambda: sum(r.total_users for r in a.on_dir(spark, str(root)).collect())
    before = total()
    shutil.copy(src / "customer.parquet", root / "customer.parquet" / "part-1.parquet")
    assert total() == 2 * before > 0


@pytest.mark.parametrize(
    "name",
    ["platform_mix_by_region", "feature_adoption", "churn_reason_topn", "annual_revenue_growth"],
)
def test_time_windows_prune_month_partitions(name, stored):
    import re

    plan = explain(REGISTRY[name].run(stored), "formatted")
    filters = re.findall(r"PartitionFilters: \[(.*)\]", plan)
    assert any("_month" in f for f in filters), plan


def test_random_tables_on_partitioned_layout(spark):
    from test_random import random_rows

    rows = random_rows(5)  # NULL times land in the default partition and never match
    root = tempfile.mkdtemp(prefix="ledgerlens-catalog-")
    write_business_tables(spark, handmade.spark_tables(spark, rows=rows), "ll_layout_rand", root, buckets=8)
    t = read_business_tables(spark, "ll_layout_rand", duplicates="ignore")
    con = handmade.duck_tables(rows=rows)
    bad = []
    for name, a in REGISTRY.items():
        with oracle.business_tables_given():
            if compare(a.run(t), con, a.sql(**a.params)):
                bad.append(name)
    assert not bad
