import subprocess
import sys
from pathlib import Path

import pytest

from ledgerlens.llm import storage

ROOT = str(Path(__file__).resolve().parents[2])


def test_works_where_no_folder_is_set():
    """A session of its own, with an empty configuration."""
    code = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 2).getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
from ledgerlens.llm.storage import cut, shared_root
assert shared_root(s) == shared_root(s)
print(cut(s, s.range(5), "x").count())
"""
    env = {"PYTHONPATH": ROOT, "PATH": "/usr/bin:/bin", "SPARK_CONF_DIR": "/nonexistent"}
    import os

    out = subprocess.run([sys.executable, "-c", code], env=os.environ | env, capture_output=True, text=True, check=True)
    assert out.stdout.strip().endswith("5")


class _Session:
    """A session on a cluster with the setting unset."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:  # noqa: N801
        master, applicationId = "spark://host:7077", "app"


def test_says_what_to_set_on_a_cluster():
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        storage.shared_root(_Session)
