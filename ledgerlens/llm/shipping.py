"""Makes this package importable in Python workers, as ``--py-files`` would."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = 1000


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through Spark, once per application.

    Workers import the operators by name and so keep their vocabulary caches from task to task.
    Where the user has not set the size of Arrow batches, it is lowered to ``BATCH`` rows: texts
    are long, and a batch is held by Spark and by the worker at the same time.
    """
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH_ROWS) and spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, BATCH)
    package = Path(__file__).resolve().parents[1]
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    # served to the executors by the driver for as long as the application runs
    bundle = Path(tempfile.mkdtemp(prefix="ledgerlens-py-")) / f"{package.name}.zip"
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(bundle))
    _SHIPPED.add(context.applicationId)
