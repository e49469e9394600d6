"""Summarise the physical plan of every analysis as it would run at scale.

    python -m ledgerlens.plans.report /root/testdata/sf0.01 > PLANS.md

The business tables are derived from the test data once and stored as Parquet; the plans
are taken with AQE and static broadcasts off, so every join shows as the shuffle join it
is when all inputs are large (at run time AQE may still broadcast a side it has measured
small, or split a skewed partition).
"""

from __future__ import annotations

import re
import sys
import tempfile
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from ..sources import (
    TABLE_NAMES,
    fixture_tables,
    read_business_tables,
    read_parquet_tables,
    write_business_tables,
)
from .inspect import explain, pair_nodes, pushed_filters, python_nodes, single_partition_inputs
from .registry import REGISTRY


def summarize(df: DataFrame) -> dict[str, object]:
    plan = explain(df, "simple")
    joins = Counter(
        m.group(1) + " " + m.group(2)
        for m in re.finditer(
            r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)[^\n]*?"
            r"(Inner|LeftOuter|FullOuter|LeftSemi|LeftAnti)",
            plan,
        )
    )
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    return {
        "hash_exchanges": len(keys),
        "exchange_keys": Counter(
            "(" + re.sub(r"#\d+L?", "", k).replace("_groupingexpression", "expr") + ")"
            for k in keys
        ),
        "single_partition": plan.count("Exchange SinglePartition"),
        "range_exchanges": plan.count("Exchange rangepartitioning"),
        "joins": joins,
        "aggregates": len(re.findall(r"HashAggregate\(", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "top_k": "TakeOrderedAndProject" in plan,
        "pushed": [p for p in pushed_filters(explain(df, "formatted")) if p.strip() != "[]"],
        "python": python_nodes(plan),
        "pairs": pair_nodes(plan),
        "single_partition_over": single_partition_inputs(plan),
    }


def _split_filters(line: str) -> list[str]:
    """``[A(x), Not(B(y,z)), In(c, [1,2])]`` -> the top-level filters."""
    body = line.strip()
    if body.startswith("[") and body.endswith("]"):
        body = body[1:-1]
    out, depth, cur = [], 0, ""
    for ch in body:
        if ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    if cur.strip():
        out.append(cur.strip())
    return out


def _fmt(c: Counter) -> str:
    return ", ".join(f"{k} x{v}" if v > 1 else k for k, v in sorted(c.items())) or "-"


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "2000")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="ledgerlens-plans-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="ledgerlens-plans-")
    derived = fixture_tables(spark, sf_dir)
    for name in TABLE_NAMES:
        getattr(derived, name).write.parquet(f"{root}/{name}")
    t = read_parquet_tables(spark, root)
    for name in TABLE_NAMES:
        getattr(t, name)  # checked on first use, before broadcasts are switched off
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    print(
        "| analysis | hash exchanges (keys) | single-partition | joins | aggregates | windows "
        "| top-k |"
    )
    print("|---|---|---|---|---|---|---|")
    for name, a in REGISTRY.items():
        s = summarize(a.run(t))
        assert not s["python"] and not s["pairs"], name
        single = str(s["single_partition"])
        if s["single_partition"]:
            single += f" (over {', '.join(sorted(set(s['single_partition_over'])))})"
        print(
            f"| `{name}` | {_fmt(s['exchange_keys'])} | {single} | {_fmt(s['joins'])} | "
            f"{s['aggregates']} | {s['windows']} | {'yes' if s['top_k'] else '-'} |"
        )
    print()
    print("Filters pushed into the Parquet scans (besides IsNotNull):")
    print()
    print("| analysis | pushed filters |")
    print("|---|---|")
    for name, a in REGISTRY.items():
        s = summarize(a.run(t))
        found = []
        for line in s["pushed"]:
            for f in _split_filters(line):
                if not f.startswith("IsNotNull") and f not in found:
                    found.append(f)
        print(f"| `{name}` | {', '.join(found) or '-'} |")

    # the recommended stored layout: dimensions bucketed by user, facts by month
    write_business_tables(spark, derived, "ledgerlens_report", f"{root}/layout", buckets=2000)
    stored = read_business_tables(spark, "ledgerlens_report")
    print()
    print("On the stored layout of `sources.layout` (users and geo_data bucketed by user_id,")
    print("fact tables partitioned by month):")
    print()
    print("| analysis | hash exchanges (keys) | partition filters |")
    print("|---|---|---|")
    for name, a in REGISTRY.items():
        df = a.run(stored)
        s = summarize(df)
        parts = sorted(set(re.findall(r"PartitionFilters: \[([^\]]+)\]", explain(df, "formatted"))))
        cleaned = [re.sub(r"#\d+", "", p) for p in parts]
        print(f"| `{name}` | {_fmt(s['exchange_keys'])} | {'; '.join(cleaned) or '-'} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
