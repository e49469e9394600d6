"""Stored states: every fact table reduced once per month, read by all analyses, refreshed by month.

``refresh_states`` compares the files of each month of each fact table with those of the last
refresh, reads the months that are new or changed (late rows included), groups them (``facts.py``)
and commits a version that names the new months' files beside the old ones of all others. Each
changed month of a fact is read once, whatever the number of analyses; a month without change is not
opened. User sets are made from the new states, not from the facts. ``read_states`` gives
``Tables`` whose facts and user sets come from one version; dimensions and everything exact to the
instant still come from the base tables.

A table that isn't stored by month (``layout.py``) has one mark for all its files: any change reads
all of it. Sets are stored where ids are dense: bitmaps of at least ``DENSE`` users each on average; in a table
of scattered ids they would take more room than the users, and the analyses build them from the states.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fmt import year_month
from .facts import FACTS, USER_SETS
from .quality import Quality, orphans
from .schema import SCHEMAS
from .store import Store
from .tables import Tables

MONTH = "_m"  # folder of a month, YYYY-MM
NO_MONTH = "none"  # rows without a time
DENSE = 16  # users a bitmap of 4 KB should hold
_TIME = {"subscriptions": "start_date", "events": "first_at", "feature_usage": "month", "payments": "paid_at", "churn_events": "churn_date"}


def _month_of(name: str) -> Column:
    return F.coalesce(year_month(F.col(_TIME[name])), F.lit(NO_MONTH)).alias(MONTH)


def file_marks(spark: SparkSession, folder: str, partition: str | None) -> dict[str, str]:
    """A mark of the files of each month: it changes when a file is added, removed or rewritten.
    Files are listed, not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    month = F.lit("") if partition is None else F.regexp_extract("path", rf"/{partition}=([^/]*)/", 1)
    listed = files.select(month.alias("month"), F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    rows = listed.groupBy("month").agg(F.count("*").alias("n"), F.sum("h").alias("h")).collect()
    return {r.month: f"{r.n}:{r.h}" for r in rows}


def _of_months(df: DataFrame, partition: str, months: list[str]) -> DataFrame:
    """Rows of the given values of the month partition (a pruned scan)."""
    days = [datetime.fromisoformat(m).date() for m in months if m[:1].isdigit()]
    cond = F.col(partition).isin(days) if days else F.lit(False)
    if len(days) < len(months):
        cond = cond | F.col(partition).isNull()
    return df.where(cond)


def _schema(spark: SparkSession, name: str):
    """Schema of a stored state or user set."""
    fact = USER_SETS[name].fact if name in USER_SETS else name
    state = FACTS[fact].state(FACTS[fact].view(spark.createDataFrame([], SCHEMAS[fact])))
    return (USER_SETS[name].bitmaps(state) if name in USER_SETS else state).schema


def refresh_states(
    spark: SparkSession, t: Tables, root: str, sets: bool = True, quality: Quality | None = None
) -> dict[str, list[str]]:
    """Bring the states under ``root`` up to date with the tables' files; returns the months
    that were read, per fact (as the base table's partitions name them).

    With ``quality``, the rows that are read are counted on the way, those of users that ``users``
    doesn't have included, in the jobs that write the states."""
    store = Store(spark, root)
    old = store.latest() or {"marks": {}, "parts": {}}
    run, marks, parts, read = store.new_run(), {}, {}, {}
    for name, fact in FACTS.items():
        if name not in t.folders:
            raise ValueError(f"table {name!r} has no folder: states are made of stored tables")
        partition = t.month_partitions.get(name)
        marks[name], before = file_marks(spark, t.folders[name], partition), old["marks"].get(name, {})
        changed = sorted(m for m in marks[name] if marks[name][m] != before.get(m))
        gone = [m for m in before if m not in marks[name]]
        read[name] = changed
        mine = [name, *[s for s, u in USER_SETS.items() if u.fact == name]]
        stale = {NO_MONTH if not m[:1].isdigit() else m[:7] for m in (*changed, *gone)}
        for n in mine:
            kept = old["parts"].get(n, {})
            parts[n] = {} if partition is None and stale else {m: p for m, p in kept.items() if m not in stale}
        if not changed:
            continue
        base = getattr(t, name)
        rows = base if partition is None else _of_months(base, partition, changed)
        state = fact.state(fact.view(rows if quality is None else quality.count(name, rows)), _month_of(name))
        _write(state if quality is None else orphans(state, t.users, quality, name), store, f"{run}/{name}")
        months = store.folders(f"{run}/{name}")
        parts[name] |= {m.removeprefix(f"{MONTH}="): f"{run}/{name}/{m}" for m in months}
        new = spark.read.schema(_schema(spark, name)).parquet(*[store.path(f"{run}/{name}/{m}") for m in months]) if months else None
        for n in mine[1:] if sets and new is not None else ():
            _write(USER_SETS[n].bitmaps(new, _month_of(name)), store, f"{run}/{n}")
            parts[n] |= {m.removeprefix(f"{MONTH}="): f"{run}/{n}/{m}" for m in store.folders(f"{run}/{n}")}
    if any(read.values()) or marks != old["marks"]:
        runs = sorted({"/".join(p.split("/")[:2]) for of in parts.values() for p in of.values()})
        store.commit({"marks": marks, "parts": parts, "runs": runs})
    return read


def _write(rows: DataFrame, store: Store, name: str) -> None:
    # adaptive execution deals each month over as many files as its bytes need
    rows.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(store.path(name))


def read_states(spark: SparkSession, root: str, t: Tables) -> Tables:
    """``t`` with facts and user sets from the newest states under ``root``."""
    store = Store(spark, root)
    manifest = store.latest()
    if manifest is None:
        raise ValueError(f"no states under {root}")

    def reader(name: str, parts: dict[str, str]):
        def read(since: datetime | None, before: datetime | None) -> DataFrame:
            lo = "" if since is None else since.strftime("%Y-%m")
            hi = "~" if before is None else (before - timedelta(microseconds=1)).strftime("%Y-%m")
            # rows without a time meet no bound
            months = [m for m in parts if (m == NO_MONTH and since is None and before is None) or (m != NO_MONTH and lo <= m <= hi)]
            schema = _schema(spark, name)
            if not months:
                return spark.createDataFrame([], schema)
            return spark.read.schema(schema).parquet(*[store.path(parts[m]) for m in sorted(months)])

        return read

    usable = {n: p for n, p in manifest["parts"].items() if n not in USER_SETS or (p and _dense(spark, store, n, p))}
    return Tables(t.factories, t.month_partitions, t.bounded, {n: reader(n, p) for n, p in usable.items()}, t.folders)


def _dense(spark: SparkSession, store: Store, name: str, parts: dict[str, str]) -> bool:
    """Whether the newest month's bitmaps hold enough users each to be worth reading."""
    newest = max(parts)
    sample = spark.read.schema(_schema(spark, name)).parquet(store.path(parts[newest]))
    n, users = sample.agg(F.count("*"), F.sum(F.bitmap_count("users"))).first()
    return (users or 0) >= DENSE * n or n <= 64
