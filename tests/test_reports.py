"""Reports become visible together; a run that is killed leaves the version before."""

from __future__ import annotations

import os
import signal
import subprocess
import sys
import tempfile
import time
from pathlib import Path

import pytest

from ledgerlens.sources import read_reports, write_reports
from ledgerlens.sources.store import Store

ROOT = Path(__file__).resolve().parents[1]


def values(spark, root):
    return {name: [r[0] for r in df.collect()] for name, df in read_reports(spark, root).items()}


def frame(spark, x):
    return spark.createDataFrame([(x,)], "x int")


def test_versions(spark):
    root = tempfile.mkdtemp(prefix="ledgerlens-reports-")
    with pytest.raises(ValueError, match="no reports"):
        read_reports(spark, root)
    assert write_reports(spark, root, {"a": frame(spark, 1), "b": frame(spark, 1)}) == 0
    assert write_reports(spark, root, {"a": frame(spark, 2)}) == 1  # b stays part of the version
    assert values(spark, root) == {"a": [2], "b": [1]}
    store = Store(spark, root)
    assert [r["path"].split("/")[-1] for r in store.read(0)["reports"].values()] == ["a", "b"]
    write_reports(spark, root, {"a": frame(spark, 3), "b": frame(spark, 3)})
    write_reports(spark, root, {"a": frame(spark, 4), "b": frame(spark, 4)})
    assert store._numbers() == [2, 3] and len(store.folders("runs")) == 2  # older ones are deleted
    assert values(spark, root) == {"a": [4], "b": [4]}


def test_failed_run_leaves_the_version_before(spark):
    from pyspark.sql import functions as F

    root = tempfile.mkdtemp(prefix="ledgerlens-reports-")
    write_reports(spark, root, {"a": frame(spark, 1), "b": frame(spark, 1)})
    bad = frame(spark, 2).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        write_reports(spark, root, {"a": frame(spark, 2), "b": bad})
    assert values(spark, root) == {"a": [1], "b": [1]}
    write_reports(spark, root, {"a": frame(spark, 3), "b": frame(spark, 3)})
    assert values(spark, root) == {"a": [3], "b": [3]}


def test_unfinished_manifest_is_no_version(spark):
    root = tempfile.mkdtemp(prefix="ledgerlens-reports-")
    write_reports(spark, root, {"a": frame(spark, 1)})
    (Path(root) / "manifests" / ".half").write_text('{"reports": {"a"')
    assert values(spark, root) == {"a": [1]}


def test_two_writers_of_one_number(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="ledgerlens-reports-")
    store = Store(spark, root)
    store.commit({"reports": {}, "runs": []})
    monkeypatch.setattr(Store, "_numbers", lambda self: [])  # a writer that looked before the other's commit
    with pytest.raises(RuntimeError, match="another run"):
        store.commit({"reports": {}, "runs": []})


_KILLED = """
import sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from ledgerlens.sources import reports
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ok = spark.range(1).select(F.lit(9).alias("x"))
commit = reports.Store.commit
def late(self, *args):
    print("written", flush=True)
    time.sleep(600)
reports.Store.commit = late
reports.write_reports(spark, {out!r}, {{"a": ok, "b": ok}})
"""


def test_killed_before_the_commit(spark):
    out = tempfile.mkdtemp(prefix="ledgerlens-reports-")
    write_reports(spark, out, {"a": frame(spark, 1), "b": frame(spark, 1)})
    code = _KILLED.format(root=str(ROOT), out=out)
    p = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True, env=dict(os.environ))
    try:
        until = time.time() + 120
        while "written" not in p.stdout.readline():
            assert time.time() < until and p.poll() is None
    finally:
        os.killpg(p.pid, signal.SIGKILL)  # this child and its JVM only
        p.wait()
    assert len(Store(spark, out).folders("runs")) == 2  # all data of the killed run were there
    assert values(spark, out) == {"a": [1], "b": [1]}
