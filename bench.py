"""Headline-query benchmark.

Runs the main recommender queries at $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is run once to warm up, then timed ($BENCH_REPS runs, median) into
the ``noop`` sink, so every output column is computed.  ``growth`` repeats the
sum at the next smaller scale ($BENCH_SMALL_DIR, default sf0.01; empty: off).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ur_recommend", "llr_correlators", "pop_trending", "pop_hot", "item_docs", "aggregate_properties",
    "basket_sessions", "association_rules", "als_known_user", "cascade_recommend", "negatives_test",
    "hit_rate", "auc", "sequence_samples", "encode_samples", "ucb_arms",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "1"))
    from recoflow.plans.registry import QUERIES, load_all
    from recoflow.session import get_spark
    load_all()
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)

    def run(key: str, folder: str) -> float:
        t0 = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    keys = [k for k in HEADLINE if k in QUERIES]
    small_dir = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")
    times, small = {}, {}
    for key in keys:
        run(key, sf_dir)
        times[key] = round(statistics.median(run(key, sf_dir) for _ in range(reps)), 3)
        if small_dir:
            small[key] = round(run(key, small_dir), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "smaller": small,
           "growth": round(sum(times.values()) / sum(small.values()), 3) if small else None, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
