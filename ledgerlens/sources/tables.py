"""The set of business tables an analysis runs on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import month_floor, ts_lit
from .facts import BOUND_BY, FACTS, SET_TIME, USER_SETS
from .schema import SCHEMAS, check_schema
from .validate import require_unique

TABLE_NAMES = tuple(SCHEMAS)


@dataclass
class Tables:
    """Lazily built business tables.

    Each table is a factory that returns a DataFrame; it is built (as a logical plan, not
    executed) the first time an analysis asks for it. Analyses only touch the tables they
    need, so a query over ``churn_events`` never plans the ``payments`` derivation.
    """

    factories: dict[str, Callable[[], DataFrame]]
    # table -> name of a DATE partition column holding the first day of the month of the
    # table's time column, for tables stored partitioned that way
    month_partitions: dict[str, str] = field(default_factory=dict)
    # table -> factory that takes (since, until) and may leave out rows of other times, for
    # tables whose time column is derived: the bound is put on the columns it is derived from
    bounded: dict[str, Callable[[datetime | None, datetime | None], DataFrame]] = field(default_factory=dict)
    # fact or user set -> factory that takes (since, before) and reads its stored state of the
    # months that can hold times in between
    states: dict[str, Callable[[datetime | None, datetime | None], DataFrame]] = field(default_factory=dict)
    # table -> folder of its files, where it has one
    folders: dict[str, str] = field(default_factory=dict)
    # takes a fact table's name and the rows read from it, e.g. to count them (``quality.py``)
    watcher: Callable[[str, DataFrame], DataFrame] | None = None
    _built: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("factories", "month_partitions", "bounded", "states", "folders", "watcher"):
            raise AttributeError(name)
        if name not in self.factories:
            raise AttributeError(f"no business table {name!r}")
        if name not in self._built:
            self._built[name] = self.factories[name]()
        return self._built[name]

    def scan(
        self, name: str, since: datetime | None = None, until: datetime | None = None
    ) -> DataFrame:
        """The table, restricted to the months that can hold times in [since, until], or
        to what its bounded factory leaves.

        Callers still apply their exact time predicate; this only adds, for a table
        stored partitioned by month, the matching range on the partition column, so the
        scan skips whole partitions (directories never listed or opened). The month range
        is inclusive at both ends, a superset of any bound on the time column.
        """
        if name in self.bounded and (since is not None or until is not None):
            return self.bounded[name](since, until)
        df = getattr(self, name)
        part = self.month_partitions.get(name)
        if part is None:
            return df
        if since is not None:
            df = df.where(F.col(part) >= F.lit(month_floor(since).date()))
        if until is not None:
            df = df.where(F.col(part) <= F.lit(month_floor(until).date()))
        return df

    def facts(
        self, name: str, since: datetime | None = None, before: datetime | None = None, exact: bool = False
    ) -> DataFrame:
        """Weighted rows (``facts.py``) of a fact table with times in [since, before): of its
        state where one is stored, else (and if ``exact``) one per base row.

        Bounds of payments are month starts, and events have no upper bound, so that they decide
        over a state's rows as over base rows.
        """
        stored = name in self.states and not exact
        if stored:
            rows, column = self.states[name](since, before), BOUND_BY[name]
        else:
            rows, column = self.scan(name, since, None if before is None else before - timedelta(microseconds=1)), FACTS[name].time
        if since is not None:
            rows = rows.where(F.col(column) >= ts_lit(since))
        if before is not None:
            rows = rows.where(F.col(column) < ts_lit(before))
        if stored:
            return rows
        return FACTS[name].view(rows if self.watcher is None else self.watcher(name, rows))

    def user_sets(self, name: str, since: datetime | None = None, before: datetime | None = None) -> DataFrame:
        """Bitmaps of users (``facts.USER_SETS``) whose month or day lies in [since, before): stored
        ones where there are any, else built from the fact."""
        made, time = USER_SETS[name], SET_TIME[name]
        rows = self.states[name](since, before) if name in self.states else made.bitmaps(self.facts(made.fact, since))
        if since is not None:
            rows = rows.where(F.col(time) >= ts_lit(since))
        return rows if before is None else rows.where(F.col(time) < ts_lit(before))

    @classmethod
    def from_frames(cls, **frames: DataFrame) -> Tables:
        for name, df in frames.items():
            check_schema(name, df.schema)
        return cls({name: (lambda df=df: df) for name, df in frames.items()})


def read_parquet_tables(
    spark: SparkSession, root: str, validate: bool = True, duplicates: str = "raise"
) -> Tables:
    """Business tables stored as ``{root}/{table}`` Parquet datasets (production layout).

    Each table is read with the explicit schema. Before its first use the files' own schema
    (one footer) is checked against it, so a missing or retyped column fails here instead of
    reading as NULLs, and the key of ``users`` and ``geo_data`` is checked to be unique
    (``duplicates="ignore"`` skips that; ``validate=False`` skips both).
    The analyses put literal bounds on the time columns, which reach the scan as pushed
    filters, so row groups outside a window are skipped by their min/max statistics.
    """

    def reader(name: str) -> Callable[[], DataFrame]:
        path = f"{root}/{name}"

        def read() -> DataFrame:
            if validate:
                check_schema(name, spark.read.parquet(path).schema)
            df = spark.read.schema(SCHEMAS[name]).parquet(path)
            return require_unique(name, df) if validate and duplicates == "raise" else df

        return read

    return Tables({name: reader(name) for name in TABLE_NAMES}, folders={name: f"{root}/{name}" for name in TABLE_NAMES})
