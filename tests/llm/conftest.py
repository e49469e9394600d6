import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session", autouse=True)
def _package_on_workers(spark):
    from ledgerlens.llm.shipping import ship

    ship(spark)
