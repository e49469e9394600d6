"""Sharding by jump consistent hashing, with DataFrame functions only.

The shard of a document depends on its ``doc_id`` and the number of shards alone (law ``key``):
a pseudo-random sequence seeded by the key jumps from shard to shard until it leaves the range,
and the last shard inside is the result. With one more shard the same jumps are made, so a
document either stays or moves to the new shard, and there is no ring table to keep.

``slot`` numbers the documents of a shard from 0 without gaps, in doc_id order. It is counted in
two steps, within ranges of doc_id and over the ranges' counts, so no shard goes through one task.

Defined results: null text has size 8 and checksum 0; a null ``doc_id`` has the key 0 and comes
first; repeated rows each have a slot of their own (rows of one doc_id in the order of their
checksum and size); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

SHARDS = 24

# Fixed value of the method: multiplier of its generator, key -> key * MULTIPLIER + 1 mod 2**64.
MULTIPLIER = 2862933555777941757
_M32 = (1 << 32) - 1


def _low_product(x: Column, factor: int) -> Column:
    """x * factor mod 2**32 for 0 <= x < 2**32, without leaving the range of a BIGINT."""
    small, large = factor & 0xFFFF, factor >> 16
    return (x * small + F.shiftleft((x * large).bitwiseAND(0xFFFF), 16)).bitwiseAND(_M32)


def _jump(acc: Column) -> Column:
    """One jump: the next number of the generator, kept as two 32-bit halves."""
    hi, lo = acc["hi"], acc["lo"]
    f_hi, f_lo = MULTIPLIER >> 32, MULTIPLIER & _M32
    small, large = lo * (f_lo & 0xFFFF), lo * (f_lo >> 16)
    low = small + F.shiftleft(large.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(large, 16)
    high = (carry + _low_product(hi, f_lo) + _low_product(lo, f_hi)).bitwiseAND(_M32)
    reach = (acc["next"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1))
    return F.struct(
        high.alias("hi"),
        low.bitwiseAND(_M32).alias("lo"),
        acc["next"].alias("at"),
        acc["at"].alias("before"),
        F.floor(reach).cast("bigint").alias("next"),
    )


def jump_shards(key: Column, shards: int) -> Column:
    """Struct of the shard of a BIGINT key among ``shards`` and among one more (``grown``)."""
    start = F.struct(
        F.shiftright(key, 32).bitwiseAND(_M32).alias("hi"),
        key.bitwiseAND(_M32).alias("lo"),
        F.lit(-1).cast("bigint").alias("at"),
        F.lit(-1).cast("bigint").alias("before"),
        F.lit(0).cast("bigint").alias("next"),
    )
    # every jump moves up by one shard at least
    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, lambda acc, _: F.when(acc["next"] <= shards, _jump(acc)).otherwise(acc))
    return F.struct(
        F.when(end["at"] == shards, end["before"]).otherwise(end["at"]).cast("int").alias("shard"),
        end["at"].cast("int").alias("grown"),
    )


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(bytes_).cast("bigint") + 8).alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
    )
    key = F.coalesce("doc_id", F.lit(0).cast("bigint"))
    # one key may hold very many rows: the last column of the range key lets them spread
    order = ["doc_id", "text_crc32", "size", "row"]
    ranged = placed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order)
    numbered = ranged.withColumn("part", F.spark_partition_id()).withColumn("to", jump_shards(key, shards))
    stored = cut(docs.sparkSession, numbered, "shards")
    counts = stored.groupBy("part", F.col("to.shard").alias("shard")).count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order))
    rows = stored.withColumn("shard", F.col("to.shard")).withColumn("nth", within).join(base, ["part", "shard"])
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("base") + F.col("nth") - 1).alias("slot"),
        F.col("to.grown").alias("grown_shard"),
    )


def oracle(shards: int = SHARDS) -> str:
    """The same result in DuckDB SQL, with 128-bit integers and a checksum table by rule."""
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    [n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), jumps(doc_id, k, cur, prev, nxt) AS (
  SELECT DISTINCT doc_id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616,
         -1::BIGINT, -1::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, n, nxt, cur, floor((nxt + 1) * (2147483648.0::DOUBLE / (n // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, cur, nxt, (k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616 AS n FROM jumps WHERE nxt <= {shards})
), placed AS (
  SELECT doc_id, CASE WHEN cur = {shards} THEN prev ELSE cur END AS shard, cur AS grown FROM jumps WHERE nxt > {shards}
), sums AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                                      lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
  FROM documents, crc
)
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, s.text_crc32, s.size) - 1 AS slot,
  grown::INTEGER AS grown_shard
FROM sums s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""
