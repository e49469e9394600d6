"""Data quality counted inside the queries that read the data, by ``DataFrame.observe``.

``Quality.watch`` gives tables that count what passes: rows, keys and times that are NULL, values
that no rule knows, rows of a key that should be unique. The counts come with the result of the
query itself, so there is no further job and no further scan. They hold for the rows that the query
reads (after its time bounds; other filters stay above the counting). The unique keys of ``users`` and
``geo_data`` are counted by a window over the key, which the joins on it need dealt that way anyway.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .validate import UNIQUE_KEYS

if TYPE_CHECKING:
    from .tables import Tables

# Values that count as known by default: those the specification names, a paused subscription, and
# the ways a payment ends. A caller's own lists replace them.
PLANS = ("free", "plus", "business", "enterprise")
KNOWN: dict[str, dict[str, tuple[str, ...]]] = {
    "users": {"plan_type": PLANS},
    "subscriptions": {"plan": PLANS, "status": ("active", "churned", "paused")},
    "payments": {"status": ("completed", "refunded", "failed")},
    "churn_events": {"plan": PLANS},
}
NOT_NULL = {
    "users": ("user_id", "signup_date"),
    "subscriptions": ("user_id", "start_date"),
    "events": ("user_id", "created_at"),
    "feature_usage": ("user_id", "month"),
    "payments": ("user_id", "payment_date", "amount"),
    "churn_events": ("user_id", "churn_date"),
    "geo_data": ("user_id",),
}


def _count(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def measures(name: str, known: dict[str, dict[str, tuple[str, ...]]] = KNOWN) -> dict[str, Column]:
    """The counts of one table, as aggregates over its rows."""
    out = {"rows": F.count(F.lit(1))}
    out |= {f"null_{c}": _count(F.col(c).isNull()) for c in NOT_NULL[name]}
    # NULL is counted above where it matters, and is no unknown value
    out |= {f"unknown_{c}": _count(~F.col(c).isin(*values)) for c, values in known.get(name, {}).items()}
    return out


class Quality:
    """Counts of the tables read by queries over ``watch(tables)``."""

    def __init__(self, known: dict[str, dict[str, tuple[str, ...]]] = KNOWN):
        self.known = known
        self._reads: list[tuple[str, Observation]] = []

    def _observe(self, name: str, df: DataFrame, counts: dict[str, Column]) -> DataFrame:
        o = Observation(f"{name}-{uuid.uuid4().hex}")
        self._reads.append((name, o))
        return df.observe(o, *[c.alias(k) for k, c in counts.items()])

    def count(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, rows of table ``name``, with its counts observed."""
        counts = measures(name, self.known)
        keys = UNIQUE_KEYS.get(name)
        if not keys:
            return self._observe(name, df, counts)
        columns = df.columns
        copies = df.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        unique = F.col("_copies") > 1
        for k in keys:
            unique = unique & F.col(k).isNotNull()
        return self._observe(name, copies, counts | {"repeated_key_rows": _count(unique)}).select(*columns)

    def watch(self, t: Tables) -> Tables:
        """``t``, counting; facts are counted where an analysis bounds them in time."""

        def counted(name: str):
            make = t.factories[name]
            return lambda: self.count(name, make())

        factories = {name: (counted(name) if name in UNIQUE_KEYS else make) for name, make in t.factories.items()}
        return replace(t, factories=factories, watcher=self.count, _built={})

    def report(self) -> list[tuple[str, str, int]]:
        """(table, measure, count) of all reads so far; the queries must have run."""
        out: dict[tuple[str, str], int] = {}
        for name, o in self._reads:
            for k, v in o.get.items():
                out[name, k] = max(out.get((name, k), 0), v)
        return [(name, k, v) for (name, k), v in out.items()]

    def problems(self) -> list[tuple[str, str, int]]:
        """The measures other than row counts that aren't 0."""
        return [r for r in self.report() if r[1] != "rows" and r[2]]


def orphans(rows: DataFrame, users: DataFrame, quality: Quality, name: str) -> DataFrame:
    """``rows`` (with ``user_id``), counting those whose user ``users`` doesn't have, as
    ``orphan_rows`` of table ``name``: one left join on distinct ids, no rows lost or added."""
    known = users.select(F.col("user_id").alias("_user")).where("_user IS NOT NULL").distinct()
    columns = rows.columns
    joined = rows.join(known, F.col("user_id") == F.col("_user"), "left")
    orphan = F.col("_user").isNull() & F.col("user_id").isNotNull()
    weight = F.sum(F.when(orphan, F.col("rows")).otherwise(0)) if "rows" in columns else _count(orphan)
    return quality._observe(name, joined, {"orphan_rows": F.coalesce(weight, F.lit(0)).cast("bigint")}).select(*columns)
