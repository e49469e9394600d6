"""bench.py runs end to end and prints exactly one JSON line."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")
def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2", BENCH_REPEATS="1")
    out = subprocess.run(
        [sys.executable, str(ROOT / "bench.py")],
        env=env,
        capture_output=True,
        text=True,
        timeout=900,
        check=True,
    ).stdout.strip().splitlines()
    assert len(out) == 1
    d = json.loads(out[0])
    assert d["unit"] == "sec" and d["sf"] == "0.001"
    assert len(d["queries"]) == 16 and len(d["variants"]) == 5
    assert abs(d["value"] - sum(d["queries"].values())) < 1e-3
    assert len(d["on_business_tables"]["queries"]) == 16
