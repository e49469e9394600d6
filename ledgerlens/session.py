"""Spark session settings the analyses are tuned for.

On a cluster the session comes from the platform; ``tuned_conf`` lists the settings to
put in it. ``local_session`` is for tests and the benchmark.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def tuned_conf(shuffle_partitions: int) -> dict[str, str]:
    return {
        # AQE re-plans at every shuffle boundary from measured sizes: it turns a
        # sort-merge join into a broadcast join only when the built side is measured
        # small (so no unchecked broadcast), coalesces small shuffle partitions, and
        # splits skewed join partitions (a hot user_id).
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Coalescing keeps at least one partition per core (Spark's default, stated here
        # on purpose): a shuffle of a few hundred thousand rows still aggregates on all
        # cores, and at scale every shuffle is far above advisory size x cores anyway.
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A hot user_id (say a third of all events) sits in one join partition. Several
        # joins feed a groupBy(user_id), whose required partitioning would otherwise stop
        # AQE from splitting that partition; forcing the split costs one extra shuffle of
        # already partially aggregated rows (one per user and task).
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        # Broadcast bounds. Statically, only a side whose estimate (from its files on
        # disk) is under 10 MB is broadcast: dimension tables, never a fact table at
        # scale. Disabling this would make a terabyte fact table shuffle-write itself
        # before AQE could switch its join with a 25-row dimension to a broadcast.
        # Everything else is planned as a shuffle join, and AQE broadcasts a side only
        # after its stage has run and its measured size is under the adaptive bound.
        "spark.sql.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        # Upper bound: AQE only coalesces downwards. At 100 TB this is set to thousands.
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.files.maxPartitionBytes": "128m",
        # All timestamps are TIMESTAMP_NTZ; UTC keeps any zoned conversion neutral.
        "spark.sql.session.timeZone": "UTC",
        # Python-side plan building: do not ship the Python call site of every Column
        # call to the JVM (about ten extra Py4J round trips per call; this halves the
        # round trips of building a plan). Only error messages lose the Python line; plans
        # are unchanged.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session, except those its user has set already.
    ``spark.sql.shuffle.partitions`` stays the user's."""
    given = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for k, v in tuned_conf(0).items():
        if k not in given and k != "spark.sql.shuffle.partitions":
            spark.conf.set(k, v)
    return spark


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens"
) -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "8g"))
    )
    for k, v in tuned_conf(shuffle_partitions).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
