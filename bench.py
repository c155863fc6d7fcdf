"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected), after one warm-up query for JVM start-up.  Prints one
JSON line: {"metric": "total_sec", "value": N, "unit": "sec",
"queries": {...}, "sf": ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadenza.plans.queries import REGISTRY  # noqa: E402
from cadenza.session import build_session  # noqa: E402

HEADLINE = [
    "g1_candidates",        # flagship: cap, year filter, dedupe, top-N, catalogue lookup
    "g2_profile",           # ranked lists, first occurrence, genre ranking, feature means
    "l4_criteria",          # reply parsing (variant typing) + first valid attempt
    "g3_playlists",         # replies -> queries -> hits -> G1 -> lists
    "c1_search",            # catalogue search (token equi-join + top 10)
    "s6_history",           # skew-safe per-user positions
    "s7_update",
    "g6_delete_counts",
    "s14_batches",
    "r1_profile_by_month",
    "r2_genre_evolution",
    "r3_mood",
    "r6_score",
    "x3_daily",             # streaming, availableNow
    "x4_sessions_batch",    # range-partitioned sessionization
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": "16g"})
    # Warm-up: JVM, codegen caches, parquet footers.
    REGISTRY["w5_query_cap"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
