"""Benchmark the headline analyses.

Runs every registered analysis on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: one warm-up pass over the whole suite (JIT compilation of the JVM
and Spark's generated code is shared by all queries), then per query one more warm-up run
and the median of ``$BENCH_REPEATS`` (default 3) timed runs, each a full ``collect()``
(planning included). Prints one JSON line; the
``value`` is the sum of the medians of the sixteen specified analyses, exactly as
registered for the correctness check (business tables derived from the raw test tables
inside every query). The corrected variants are reported under ``variants``.

``on_business_tables`` times the same sixteen analyses over the seven business tables
written once as Parquet and read back with explicit schemas, the layout a production
deployment reads; it isolates the analyses from the test-data mapping. ``on_states`` times them over
the states of those tables, and the refresh that makes the states. Set ``BENCH_BUSINESS_TABLES=0`` to
skip both. ``bitmaps`` times the analyses that have a second form over bitmaps.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlens.plans.registry import BITMAP, CORRECTED, REGISTRY  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources import TABLE_NAMES, fixture_tables, read_parquet_tables, read_states, refresh_states  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus * 2)))
    spark = local_session(cores=cpus, shuffle_partitions=partitions, app="ledgerlens-bench")

    def timed(build) -> float:
        build().collect()  # warm-up
        times = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            build().collect()
            times.append(time.perf_counter() - t0)
        return round(statistics.median(times), 4)

    def on_dir(a):
        return lambda: a.on_dir(spark, sf_dir)

    for a in REGISTRY.values():  # suite warm-up
        on_dir(a)().collect()
    main_q = {n: timed(on_dir(a)) for n, a in REGISTRY.items() if n not in CORRECTED | BITMAP}
    variants = {n: timed(on_dir(a)) for n, a in REGISTRY.items() if n in CORRECTED}
    bitmaps = {n: timed(on_dir(a)) for n, a in REGISTRY.items() if n in BITMAP}

    stored, states = {}, {}
    if os.environ.get("BENCH_BUSINESS_TABLES", "1") != "0":
        root = tempfile.mkdtemp(prefix="ledgerlens-bench-")
        derived = fixture_tables(spark, sf_dir)
        for name in TABLE_NAMES:
            getattr(derived, name).write.mode("overwrite").parquet(f"{root}/{name}")
        t = read_parquet_tables(spark, root)
        stored = {
            n: timed(lambda a=a: a.run(t)) for n, a in REGISTRY.items() if n not in CORRECTED | BITMAP
        }
        t0 = time.perf_counter()
        refresh_states(spark, t, f"{root}/states")
        refresh = round(time.perf_counter() - t0, 4)
        reduced = read_states(spark, f"{root}/states", t)
        for a in REGISTRY.values():
            a.run(reduced).collect()
        states = {n: timed(lambda a=a: a.run(reduced)) for n, a in REGISTRY.items() if n not in CORRECTED}

    sf = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum_of_median_query_seconds",
                "value": round(sum(main_q.values()), 4),
                "unit": "sec",
                "queries": main_q,
                "variants": variants,
                "on_business_tables": {
                    "value": round(sum(stored.values()), 4),
                    "queries": stored,
                },
                "bitmaps": bitmaps,
                "on_states": {
                    "refresh": refresh if states else None,
                    "value": round(sum(v for n, v in states.items() if n not in BITMAP), 4),
                    "queries": states,
                },
                "sf": sf,
                "cpus": cpus,
                "shuffle_partitions": partitions,
                "repeats": repeats,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
