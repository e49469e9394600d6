"""The command-line runner writes each analysis as Parquet."""

from __future__ import annotations

import tempfile
from pathlib import Path

import pytest

from ledgerlens.__main__ import main
from ledgerlens.sources import read_reports

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")
def test_cli_writes_reports(spark):
    out = tempfile.mkdtemp(prefix="ledgerlens-cli-")
    main(["--fixture", SF, "--only", "plan_user_distribution,health_dashboard", "--out", out])
    reports = read_reports(spark, out)
    got = reports["plan_user_distribution"]
    assert got.columns == ["plan_type", "total_users", "pct_of_total"]
    assert got.count() > 0
    assert reports["health_dashboard"].count() == 1


def test_sql_views(spark):
    import handmade
    from ledgerlens.plans.views import register_views

    names = register_views(spark, handmade.spark_tables(spark), prefix="v_")
    assert "v_region_revenue_arpu" in names and "v_payments" in names
    got = spark.sql(
        "SELECT region, total_users FROM v_region_revenue_arpu WHERE region = 'North'"
    ).collect()
    assert [tuple(r) for r in got] == [("North", 3)]
    n = spark.sql("SELECT count(*) FROM v_payments WHERE status = 'completed'").first()[0]
    assert n == 7


def test_cli_reads_catalog_layout(spark):
    import handmade
    from ledgerlens.sources import write_business_tables

    root = tempfile.mkdtemp(prefix="ledgerlens-cli-db-")
    write_business_tables(spark, handmade.spark_tables(spark), "ll_cli_db", root, buckets=8)
    out = tempfile.mkdtemp(prefix="ledgerlens-cli-out-")
    main(["--database", "ll_cli_db", "--only", "platform_mix_by_region", "--as-of", "2025-08-01", "--duplicates", "ignore", "--out", out])
    assert read_reports(spark, out)["platform_mix_by_region"].count() > 0


def test_cli_refreshes_and_uses_states(spark, capsys):
    import handmade
    from ledgerlens.sources import write_business_tables

    root, out, states = (tempfile.mkdtemp(prefix=f"ledgerlens-cli-{x}-") for x in ("db", "out", "states"))
    write_business_tables(spark, handmade.spark_tables(spark), "ll_cli_states", root, buckets=8)
    given = ["--database", "ll_cli_states", "--as-of", "2025-08-01", "--duplicates", "ignore", "--states", states, "--out", out, "--quality"]
    main([*given, "--only", "top_countries,upgrade_triggers,monthly_churn_rate_bitmap"])
    first = capsys.readouterr().err
    months = {(r[4].year, r[4].month) for r in handmade.PAYMENTS}
    assert f"states of payments: {len(months)} months read" in first
    assert "quality of payments: null_amount 1" in first and "quality of geo_data: repeated_key_rows 2" in first
    want = {n: df.collect() for n, df in read_reports(spark, out).items()}
    assert set(want) == {"top_countries", "upgrade_triggers", "monthly_churn_rate_bitmap"} and all(want.values())
    main([*given, "--only", "top_countries,monthly_churn_rate_bitmap"])  # the third report stays
    assert "states of payments: 0 months read" in capsys.readouterr().err
    assert {n: df.collect() for n, df in read_reports(spark, out).items()} == want


def test_cli_prints_every_row(capsys):
    main(["--fixture", "/root/testdata/sf0.01", "--as-of", "2025-08-01", "--only", "monthly_churn_rate"])
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0] == "== monthly_churn_rate" and lines[1].startswith("plan,month,")
    assert len(lines) == 2 + 48


@pytest.fixture(scope="module")
def stored(spark):
    from ledgerlens.sources import TABLE_NAMES, fixture_tables

    root = tempfile.mkdtemp(prefix="ledgerlens-cli-tables-")
    t = fixture_tables(spark, SF)
    for name in TABLE_NAMES:
        getattr(t, name).write.parquet(f"{root}/{name}")
    return root


def test_cli_uses_the_analyses_own_defaults(spark, stored):
    from ledgerlens import operators as ops
    from ledgerlens.sources import read_parquet_tables

    out = tempfile.mkdtemp(prefix="ledgerlens-cli-out-")
    main(["--tables", stored, "--only", "health_dashboard", "--as-of", "2025-08-01", "--out", out])
    want = ops.health_dashboard(read_parquet_tables(spark, stored), as_of="2025-08-01").collect()
    assert read_reports(spark, out)["health_dashboard"].collect() == want
    changed = tempfile.mkdtemp(prefix="ledgerlens-cli-out-")
    main(["--tables", stored, "--only", "health_dashboard", "--as-of", "2025-08-01", "--plus-base", "1000", "--out", changed])
    assert read_reports(spark, changed)["health_dashboard"].collect() != want


def test_unknown_parameters_raise(spark, stored):
    import handmade
    from ledgerlens.plans.registry import REGISTRY
    from ledgerlens.plans.views import register_views

    t = handmade.spark_tables(spark)
    with pytest.raises(TypeError, match="nonsense"):
        main(["--tables", stored, "--only", "mrr_by_plan", "--set", "nonsense=1"])
    with pytest.raises(TypeError, match="as_of"):
        main(["--tables", stored, "--only", "mrr_by_plan", "--as-of", "2025-08-01"])
    with pytest.raises(TypeError, match="nonsense"):
        register_views(spark, t, nonsense=1)
    with pytest.raises(TypeError, match="per_user"):
        REGISTRY["feature_adoption_per_user"].on(t, per_user=False)
    register_views(spark, t, as_of="2025-08-01", prefix="o_", plan="business", top_n=2)
    assert spark.table("o_churn_reason_topn").count() <= 2
