"""Run a registered analysis on Spark and its oracle SQL on DuckDB, and compare.

Also usable from the command line:
    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW_TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    cols = df.columns
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql: str) -> tuple[list[str], list[tuple]]:
    rel = con.sql(sql)
    cols = rel.columns
    return cols, [tuple(_norm(v) for v in row) for row in rel.fetchall()]


SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "int": "INTEGER",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between the two results (empty list when they match): column names,
    column types, row count, the multiset of rows, and the order of rows (both sides sort,
    with the placement of NULLs stated)."""
    s_cols, s_rows = rows_of_spark(spark_df)
    d_cols, d_rows = rows_of_duck(con, sql)
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        return [f"columns differ: spark {s_cols} vs oracle {d_cols}"]
    s_types = {
        f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
        for f in spark_df.schema.fields
    }
    d_types = dict(zip(d_cols, (str(t) for t in con.sql(sql).types)))
    if s_types != d_types:
        diff = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
        problems.append(f"types differ (spark, oracle): {diff}")
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    s_set = Counter(tuple(r[i] for i in si) for r in s_rows)
    d_set = Counter(tuple(r[i] for i in di) for r in d_rows)
    if len(s_rows) != len(d_rows):
        problems.append(f"row count: spark {len(s_rows)} vs oracle {len(d_rows)}")
    if s_set != d_set:
        only_s = list((s_set - d_set).elements())[:5]
        only_d = list((d_set - s_set).elements())[:5]
        problems.append(f"values differ; columns {order}\n  spark only: {only_s}\n  oracle only: {only_d}")
    elif not problems:
        s_list = [tuple(r[i] for i in si) for r in s_rows]
        d_list = [tuple(r[i] for i in di) for r in d_rows]
        at = next((i for i, (x, y) in enumerate(zip(s_list, d_list)) if x != y), None)
        if at is not None:
            problems.append(f"order differs at row {at}: spark {s_list[at]} vs oracle {d_list[at]}")
    return problems


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from ledgerlens.plans.registry import REGISTRY
    from ledgerlens.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(REGISTRY)
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name in names:
        a = REGISTRY[name]
        sql = a.oracle_sql()
        df = a.on_dir(spark, sf_dir)
        if sql is None:
            print(f"{name}: no oracle, {df.count()} rows")
            continue
        problems = compare(df, con, sql)
        print(f"{name}: {'OK' if not problems else 'MISMATCH'}")
        for p in problems:
            print("   ", p)
        bad += bool(problems)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
