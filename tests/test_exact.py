"""The exact rounding helper against Python's decimal arithmetic."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from ledgerlens.functions import ratio
from ledgerlens.functions.fmt import dollars


def _expected(n: int, d: int, digits: int):
    if d == 0:
        return None
    q = (Decimal(n) / Decimal(d)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)
    return float(q)


def test_ratio_matches_decimal_half_away_from_zero(spark):
    rng = random.Random(7)
    cases = [(201 * 100, 20000), (1, 8), (-1, 8), (5, -8), (-5, -8), (0, 3), (3, 0), (15, 1000)]
    for _ in range(3000):
        d = rng.choice([rng.randint(-50, 50), rng.randint(1, 10**9)])
        n = rng.randint(-(10**12), 10**12)
        cases.append((n, d))
        # exact halves at 0, 1 and 2 digits
        cases.append((rng.randint(-1000, 1000) * 2 + 1, 2))
        cases.append((rng.randint(-1000, 1000) * 2 + 1, 200))
    df = spark.createDataFrame(cases, "n bigint, d bigint")
    out = df.select(
        "n",
        "d",
        ratio(F.col("n"), F.col("d"), 0).alias("r0"),
        ratio(F.col("n"), F.col("d"), 1).alias("r1"),
        ratio(F.col("n"), F.col("d"), 2).alias("r2"),
    ).collect()
    for row in out:
        for digits, got in enumerate((row.r0, row.r1, row.r2)):
            assert got == _expected(row.n, row.d, digits), (row.n, row.d, digits, got)


def test_ratio_survives_products_beyond_bigint(spark):
    from ledgerlens.functions import big

    df = spark.createDataFrame([(7_000_000, 10**12)], "n bigint, c bigint")
    # 7e6 * 21 * 144 * 1e12 is about 2e22, far past the BIGINT range
    got = df.select(ratio(big(F.col("n")) * 21 * 144 * big(F.col("c")), 10**9, 0)).first()[0]
    assert got == float(7_000_000 * 21 * 144 * 10**12 // 10**9)


def test_dollar_format(spark):
    df = spark.createDataFrame([(1234567,), (0,), (None,), (12345678901,)], "x bigint")
    got = [r[0] for r in df.select(dollars(F.col("x"))).collect()]
    assert got == ["$1,234,567", "$0", None, "$12,345,678,901"]


def test_oracle_rounding_matches_decimal():
    # the oracle's SQL version of the rounding rule, checked on its own
    import duckdb

    from ledgerlens.oracle import r

    rng = random.Random(3)
    cases = [(201 * 100, 20000), (1, 8), (-1, 8), (5, -8), (0, 3), (3, 0)]
    cases += [(rng.randint(-(10**12), 10**12), rng.choice([rng.randint(-50, 50), rng.randint(1, 10**9)])) for _ in range(2000)]
    cases += [(rng.randint(-1000, 1000) * 2 + 1, 200) for _ in range(500)]
    con = duckdb.connect()
    con.execute("CREATE TABLE c (n BIGINT, d BIGINT)")
    con.executemany("INSERT INTO c VALUES (?, ?)", cases)
    rows = con.execute(f"SELECT n, d, {r('n', 'd', 0)}, {r('n', 'd', 1)}, {r('n', 'd', 2)} FROM c").fetchall()
    for n, d, *got in rows:
        for digits, value in enumerate(got):
            assert value == _expected(n, d, digits), (n, d, digits, value)
