"""Run the analyses, the way the original script is run against a database.

    python -m ledgerlens --tables /data/analytics --out /data/reports
    python -m ledgerlens --fixture /root/testdata/sf0.01 --as-of 2025-08-01 --only region_revenue_arpu

``--tables`` reads the seven business tables from ``{root}/{table}`` (Parquet),
``--database`` from the catalog layout of ``sources.write_business_tables`` (bucketed
dimensions, month-partitioned facts); with ``--fixture`` they are derived from the TPC-H
style test tables. With ``--out`` all results are written as Parquet and become visible together as
a new version of the folder (``sources.read_reports`` reads the newest); without it all rows are
printed as CSV, streamed partition by partition. ``--states`` first brings the states in a folder up
to date (each new or changed month of a fact is read once) and runs the analyses over them.
``--quality`` counts NULL keys, unknown values, repeated and orphan keys on the way and prints them to stderr.

Parameters keep the analyses' own defaults (the time of the run for ``--as-of``) unless
given; ``--set name=value`` sets any of them, and a name that no chosen analysis has is an error.
"""

from __future__ import annotations

import argparse
import ast
import csv
import sys

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans.registry import REGISTRY, split_overrides
from ledgerlens.session import tune
from ledgerlens.sources import (
    Quality,
    fixture_tables,
    read_business_tables,
    read_parquet_tables,
    read_states,
    refresh_states,
    write_reports,
)


def _value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def print_csv(name: str, df: DataFrame) -> None:
    """All rows in the result's order; the driver holds one partition at a time."""
    print(f"== {name}")
    out = csv.writer(sys.stdout, lineterminator="\n")
    out.writerow(df.columns)
    for row in df.toLocalIterator():
        out.writerow(["" if v is None else v for v in row])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ledgerlens")
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="root of the business tables (Parquet)")
    src.add_argument("--database", help="catalog database written by write_business_tables")
    src.add_argument("--fixture", help="directory of the TPC-H style test tables")
    p.add_argument("--as-of", help="evaluation instant, ISO format (default: now)")
    p.add_argument("--only", help="comma-separated analysis names")
    p.add_argument("--out", help="write all results as Parquet, as a new version of this folder")
    p.add_argument("--states", help="folder of the states to refresh and use (with --tables or --database)")
    p.add_argument("--quality", action="store_true", help="count faulty keys and values while reading")
    p.add_argument("--duplicates", choices=("raise", "ignore"), default="raise", help="rows of users or geo_data that repeat a user")
    p.add_argument("--plus-base", type=int, help="dashboard: size of the plan's user base")
    p.add_argument("--ai-feature", help="feature compared in 3.2 and 6.1")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="any other parameter")
    args = p.parse_args(argv)

    spark = tune(SparkSession.builder.appName("ledgerlens").getOrCreate())
    if args.tables:
        t = read_parquet_tables(spark, args.tables, duplicates=args.duplicates)
    elif args.database:
        t = read_business_tables(spark, args.database, duplicates=args.duplicates)
    else:
        t = fixture_tables(spark, args.fixture)
    quality = Quality() if args.quality else None
    if args.states:
        for name, months in refresh_states(spark, t, args.states, quality=quality).items():
            print(f"states of {name}: {len(months)} months read", file=sys.stderr)
        t = read_states(spark, args.states, t)
    if quality:
        t = quality.watch(t)
    names = args.only.split(",") if args.only else list(REGISTRY)
    given = {k: _value(v) for k, _, v in (x.partition("=") for x in args.set)}
    if args.as_of is not None:
        given["as_of"] = args.as_of
    if args.plus_base is not None:
        given["plus_base"] = args.plus_base
    if args.ai_feature is not None:
        given |= {k: args.ai_feature for k in ("feature", "ai_feature") if any(REGISTRY[n].accepts(k) for n in names)}
    results = {name: REGISTRY[name].on(t, **params) for name, params in split_overrides(names, given).items()}
    if args.out:
        write_reports(spark, args.out, results)
    else:
        for name, df in results.items():
            print_csv(name, df)
    if quality:
        for table, measure, n in quality.report():
            print(f"quality of {table}: {measure} {n}", file=sys.stderr)


if __name__ == "__main__":
    main()
