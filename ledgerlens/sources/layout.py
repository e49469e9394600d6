"""A stored layout of the business tables for repeated analysis.

The per-user dimension tables (``users``, ``geo_data``: one row per user) are bucketed and
sorted by ``user_id``, so the analyses join them to each other without a shuffle and
every other side only has to be shuffled into the same buckets. The fact tables
(payments, events, subscriptions, usage, churn) are deliberately *not* bucketed by user:
a user holding a third of a fact table would put a third of it into one bucket, which a
single task reads. Stored as plain Parquet they are scanned in byte-sized splits, and the
analyses collapse each user with a map-side partial aggregate before any shuffle. They
are partitioned by the month of their time column (the analyses' ``as_of`` windows then
prune whole partitions, see ``Tables.scan``) and written in time order.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import month_start
from .schema import check_schema
from .tables import TABLE_NAMES, Tables
from .validate import require_unique

BUCKETED_BY_USER = ("users", "geo_data")
# Fact tables are dealt by range of (month, time) and written in that order, so each file
# covers a narrow time range and the analyses' pushed time bounds skip files and row groups by
# their min/max statistics. Files number about the range partitions plus the months: adaptive
# execution sizes the partitions by bytes, and a month that ends inside one adds one more file.
TIME_COLUMN = {
    "subscriptions": "start_date",
    "events": "created_at",
    "feature_usage": "month",
    "payments": "payment_date",
    "churn_events": "churn_date",
}


# DATE partition column of the month-partitioned fact tables.
MONTH_PARTITION = "_month"


def write_business_tables(
    spark: SparkSession,
    t: Tables,
    database: str,
    root: str,
    buckets: int = 1024,
    month_partitions: bool = True,
) -> None:
    """Write the seven tables under ``root`` and register them in ``database``.

    ``buckets`` should be at least ``spark.sql.shuffle.partitions`` so that the shuffled
    side of a join adopts the bucketing instead of both sides being reshuffled. With
    ``month_partitions`` the fact tables are also partitioned by the month of their time
    column (``_month``), so the analyses' time windows prune whole partitions.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}/_catalog'")
    for name in TABLE_NAMES:
        df = getattr(t, name)
        if name in TIME_COLUMN:
            order = [TIME_COLUMN[name]]
            if month_partitions:
                df = df.withColumn(MONTH_PARTITION, F.to_date(month_start(F.col(TIME_COLUMN[name]))))
                order.insert(0, MONTH_PARTITION)
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        if name in BUCKETED_BY_USER:
            # one task per bucket, so one file per bucket
            df = df.repartition(buckets, "user_id")
        w = df.write.mode("overwrite").format("parquet")
        w = w.option("path", f"{root}/{name}")
        if name in BUCKETED_BY_USER:
            w = w.bucketBy(buckets, "user_id").sortBy("user_id")
        if month_partitions and name in TIME_COLUMN:
            w = w.partitionBy(MONTH_PARTITION)
        w.saveAsTable(f"{database}.{name}")


def read_business_tables(
    spark: SparkSession, database: str, duplicates: str = "raise"
) -> Tables:
    """The stored tables, read through the catalog (which carries the bucketing), checked as
    by ``read_parquet_tables``."""

    def reader(name: str):
        def read():
            df = spark.table(f"{database}.{name}")
            check_schema(name, df.schema)
            return require_unique(name, df) if duplicates == "raise" else df

        return read

    partitions, folders = {}, {}
    for name in TABLE_NAMES:
        cols = spark.catalog.listColumns(f"{database}.{name}")
        if any(c.name == MONTH_PARTITION and c.isPartition for c in cols):
            partitions[name] = MONTH_PARTITION
        about = spark.sql(f"DESCRIBE TABLE EXTENDED {database}.{name}").where("col_name = 'Location'")
        folders[name] = about.first()["data_type"]
    return Tables({name: reader(name) for name in TABLE_NAMES}, month_partitions=partitions, folders=folders)
