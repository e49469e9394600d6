"""Ranks without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAND = 1 << 16  # consecutive key values that one window partition covers


def rank_descending(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name``: ``RANK() OVER (ORDER BY key DESC)`` of a BIGINT key, NULLs first.

    Rows are counted per key value. A key's rank is 1, plus the rows of the higher bands (one small
    array, an entry per band of ``BAND`` values that occurs), plus the rows of higher keys in its own
    band (a window over at most ``BAND`` counts). Ranks are joined back on the key, a join that
    adaptive execution broadcasts or splits; no window spans all rows, however many there are.
    """
    band = F.shiftright(F.col(key), BAND.bit_length() - 1)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), band.alias("_band"))
    bands = counts.groupBy("_band").agg(F.sum("_n").alias("_n"))
    listed = bands.agg(F.collect_list(F.struct("_band", "_n"))).scalar()
    zero = F.lit(0).cast("bigint")
    higher = F.filter("_bands", lambda b: b["_band"].isNull() | (b["_band"] > F.col("_band")))
    above = F.aggregate(higher, zero, lambda s, b: s + b["_n"])
    inside = Window.partitionBy("_band").orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
    place = counts.withColumn("_bands", listed).select(
        F.col(key).alias("_key"),
        (F.when(F.col(key).isNull(), zero).otherwise(above + F.coalesce(F.sum("_n").over(inside), zero)) + 1).alias(name),
    )
    return rows.join(place, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
