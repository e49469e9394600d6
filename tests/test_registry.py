"""The registry holds the sixteen specified analyses and the corrected variants."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_mod
from ledgerlens.plans.registry import BITMAP, CORRECTED, REGISTRY

SPECIFIED = {
    "plan_user_distribution",
    "mrr_by_plan",
    "annual_revenue_growth",
    "monthly_churn_rate",
    "churn_reason_topn",
    "churn_cohort_curve",
    "revenue_leakage",
    "feature_adoption",
    "feature_usage_vs_churn",
    "feature_stickiness",
    "region_revenue_arpu",
    "top_countries",
    "platform_mix_by_region",
    "upgrade_rate",
    "upgrade_triggers",
    "health_dashboard",
}


def test_registry_contents():
    assert set(REGISTRY) - CORRECTED - BITMAP == SPECIFIED
    assert BITMAP <= set(REGISTRY) and {n.removesuffix("_bitmap") for n in BITMAP} <= SPECIFIED
    assert CORRECTED <= set(REGISTRY) and len(CORRECTED) == 5


def test_every_oracle_reads_only_the_raw_test_tables():
    raw = {"customer", "orders", "lineitem", "events", "nation", "region"}
    oracles = entry_mod.oracle_sql()
    for name in REGISTRY:
        sql = oracles[name]
        assert sql.startswith("WITH "), name
        # every business table the statement uses is defined by the mapping CTEs
        for table in ("users", "subscriptions", "payments", "churn_events", "geo_data"):
            if f"FROM {table}" in sql or f"JOIN {table}" in sql:
                assert f"{table} AS (" in sql, (name, table)
        assert any(f"FROM {t}" in sql or f"JOIN {t}" in sql for t in raw), name


@pytest.mark.parametrize("missing", ["regex", "public_tokenizers", "tokenizers", "numpy", "pyarrow"])
def test_a_missing_package_of_an_optional_part_leaves_the_analyses(missing):
    """In a process of its own, where the package can't be imported."""
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name.split('.')[0] == {missing!r}: raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "print(*sorted(e.queries()))\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(entry_mod.__file__).parent, check=False)
    assert run.returncode == 0, run.stderr
    assert set(run.stdout.split()) >= set(REGISTRY)
