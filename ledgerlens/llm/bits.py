"""A bit table of 64-bit hashes: fixed size, no false negatives, broadcast to thin a scan before
an exact join decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64

BITS = 1 << 24  # 2 MB, however many hashes there are


def bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """The table of a BIGINT column; at most one row per 32 bits is collected."""
    place = hashes.select(F.shiftrightunsigned(column, 64 - (BITS.bit_length() - 1)).alias("p"))
    groups = place.select(F.shiftright("p", 5).alias("word"), F.expr("shiftleft(1L, cast(p % 32 as int))").alias("bit"))
    found = groups.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = h >> U64(64 - (BITS.bit_length() - 1))
    return (table[(p >> U64(5)).astype(np.int64)] >> (p & U64(31)).astype(np.uint32)) & 1 != 0
