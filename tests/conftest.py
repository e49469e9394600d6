import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from ledgerlens.session import tuned_conf

    b = SparkSession.builder.master("local[*]").appName("ledgerlens-tests")
    b = b.config("spark.ui.enabled", "false")
    # catalog tables created by tests live in a scratch folder, not the working directory
    b = b.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="ledgerlens-wh-"))
    for k, v in tuned_conf(8).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
