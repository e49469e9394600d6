"""Reports written as one version: all results of a run become visible together, or none does."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from .store import Store


def write_reports(spark: SparkSession, root: str, results: dict[str, DataFrame], keep: int = 2) -> int:
    """Write each result under a folder of this run, then commit them as the newest version;
    returns its number. Reports of earlier runs that this one doesn't make stay part of it.
    A run that fails or is killed leaves the version before as it was."""
    store = Store(spark, root)
    run = store.new_run()
    for name, df in results.items():
        df.write.parquet(store.path(f"{run}/{name}"))
    reports = dict((store.latest() or {"reports": {}})["reports"])
    at = datetime.now(timezone.utc).isoformat(timespec="seconds")
    reports |= {name: {"path": f"{run}/{name}", "written": at} for name in results}
    runs = sorted({"/".join(r["path"].split("/")[:2]) for r in reports.values()})
    return store.commit({"reports": reports, "runs": runs}, keep)


def read_reports(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The newest version's reports by name."""
    store = Store(spark, root)
    manifest = store.latest()
    if manifest is None:
        raise ValueError(f"no reports under {root}")
    return {name: spark.read.parquet(store.path(r["path"])) for name, r in manifest["reports"].items()}
