"""A run-time filter of ids: a bit table of fixed size, built by Spark and applied in a scan's stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 21  # 256 KB, however many ids there are


def _place(c: Column) -> tuple[Column, Column]:
    """Word and bit of an id."""
    at = F.pmod(F.xxhash64(c), F.lit(BITS))
    return F.shiftright(at, 6).cast("int"), at.bitwiseAND(63).cast("int")


def id_filter(ids: DataFrame, column: str, of: Column) -> Column:
    """Whether ``of`` can be among the values of ``ids``: always true for those that are, and for
    few others as long as there are far fewer than ``BITS`` distinct values.

    The table is a scalar subquery: it runs first, and its one value is part of the filter, which
    stands in front of whatever aggregate or shuffle follows.
    """
    word, bit = _place(F.col(column))
    one = F.lit(1).cast("bigint")
    words = ids.select(word.alias("w"), F.call_function("shiftleft", one, bit).alias("b"))
    blank = ids.sparkSession.range(BITS // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("b"))
    table = words.groupBy("w").agg(F.bit_or("b").alias("b")).unionAll(blank).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = table.agg(F.sort_array(F.collect_list(F.struct("w", "b")))["b"]).scalar()
    word, bit = _place(of)
    return F.call_function("shiftright", F.get(bits, word), bit).bitwiseAND(F.lit(1)) == 1
