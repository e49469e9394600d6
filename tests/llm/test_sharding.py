import zlib
from collections import Counter

import duckdb
import pytest
from llm_cases import EDGE, documents, fetch, rows_of

from ledgerlens.llm import sharding
from ledgerlens.llm.queries import ORACLE_SQL, op4_sharding


def jump(key, shards):
    """The published loop, with Python integers."""
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def expected(rows, shards=24):
    placed = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(d or 0, shards), jump(d or 0, shards + 1)) for d, t in rows]
    placed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    slots, out = Counter(), []
    for d, size, crc, s, grown in placed:
        out.append((d, size, crc, "key", s, slots[s], grown))
        slots[s] += 1
    return sorted(out, key=repr)


def test_whole_table(spark):
    got = op4_sharding(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert rows_of(got) == expected(fetch("documents", "doc_id, text"))


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op4_sharding"]).fetchall(), key=repr) == rows_of(op4_sharding(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("shards", [1, 2, 24, 100])
def test_edge_rows(spark, shards):
    rows = [*EDGE, (-5, "negative"), (2**63 - 1, "large"), (-(2**63), "least")]
    assert rows_of(sharding.shard(documents(spark, rows).repartition(4), shards)) == expected(rows, shards)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = [(i * 7919, "t") for i in range(3000)]
    got = sharding.shard(documents(spark, rows)).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {24}
    assert 0.5 * 3000 / 25 < len(moved) < 1.6 * 3000 / 25
    assert set(range(24)) == {r.shard for r in got}


def test_hot_id_and_empty_table(spark):
    rows = [(7, "same")] * 500 + [(i, f"t{i}") for i in range(100)]
    assert rows_of(sharding.shard(documents(spark, rows).repartition(8))) == expected(rows)
    assert sharding.shard(documents(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = op4_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_clashing_columns(spark):
    docs = documents(spark, EDGE).withColumnsRenamed({"lang": "row", "source": "part", "n_chars": "shard"})
    assert rows_of(sharding.shard(docs)) == expected(EDGE)
