"""Every operator that SQL can express, against DuckDB over the sf0.01 tables."""

import duckdb
import pytest
from llm_cases import rows_of

from ledgerlens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.select(*columns)) == sorted(result.fetchall(), key=repr)


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, len(numbers) + 1))
